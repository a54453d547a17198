"""Toxicity scores from a lexicon matched through Levenshtein automata.

1. Lexicon: all words of labelled training documents whose document-frequency
   log-odds for toxic documents are high for certain (a partial aggregate over
   words, a lower bound of the log-odds; as many words as pass, which the sample
   of labelled rows bounds, are broadcast).
2. Matching: the Levenshtein automaton of a word of a text (distance 1, or 2
   for long words) is intersected with a trie of the lexicon.  Transitions of the
   automata are shared between words, branches of the trie without a term of
   fitting length, letters and letter pairs are left out, and results are
   memoised per worker (bounded).
3. Context: a window of words around each hit tells a quoted mention
   (quotation marks, reporting words) from direct abuse; quoted hits weigh
   less.
4. A logistic regression over the hit features, fitted on the training
   sample, gives the score.

Labels are read only for ids whose crc32 (of the id as text) modulo 4 is not
2, and at most about ``max_labelled`` of them (a hash sample beyond that; a
parameter).  Labels, lang, source and doc_id are no inputs of a score.  The
whole corpus is scored in one map-only pass.

Defined results: null and empty texts get the score of a text without hits;
repeated rows give repeated results; rows with a null id are scored and count
as not held out; without labelled rows of both classes every score is 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import MEMO_PIECE, Memo, doc_fields, materialize

WORD = r"\p{L}+"
QUOTES = "\"'“”„«»‘’‹›`"
REPORTING = frozenset("said says say wrote quote quoted quotes called calls word words term terms phrase reads reported".split())
#: Words on each side of a hit that belong to its context.
WINDOW = 5
QUOTED_WEIGHT = 0.3
FUZZY_WEIGHT = 0.6
HELD_OUT = 2


def max_distance(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


def signatures(words: list[str]) -> np.ndarray:
    """Letters (row 0, 64 bins) and pairs of neighbouring letters (rows 1 and
    2, 128 bins) of words of one length, as bit sets: an edit changes at most
    two letter bits and four pair bits."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
    one, low = np.uint64(1), np.uint64(63)
    pairs = codes[:, :-1] * np.uint64(31) + codes[:, 1:]
    bits, upper = one << (pairs & low), pairs & np.uint64(64) != 0
    parts = (one << (codes & low), np.where(upper, 0, bits), np.where(upper, bits, 0))
    return np.stack([np.bitwise_or.reduce(p.astype(np.uint64), axis=1) for p in parts])


#: Transitions of the Levenshtein automata seen so far.  A state is a set of
#: (letters of the word read beyond the offset, edits so far); its successor
#: depends only on which of the next letters of the word match, so the same
#: few transitions serve every word: (state, matches, letters left, limit) ->
#: (offset moved by, new state).
_STEPS: dict[tuple, tuple[int, tuple]] = {}


def closed(states: set, left: int, limit: int) -> tuple[int, tuple]:
    """A state with the letters that may be skipped, without entries that
    cost more than others, as (smallest offset, state relative to it)."""
    best: dict[int, int] = {}
    for i, e in states:
        for k in range(min(limit - e, left - i) + 1):
            if e + k < best.get(i + k, limit + 1):
                best[i + k] = e + k
    if not best:
        return 0, ()
    low = min(best)
    return low, tuple(sorted((i - low, e) for i, e in best.items()))


def step(state: tuple, matches: int, left: int, limit: int) -> tuple[int, tuple]:
    """One letter through the automaton; bit i of ``matches`` tells whether
    it equals the word's letter i places behind the offset."""
    key = (state, matches, left, limit)
    known = _STEPS.get(key)
    if known is None:
        out = set()
        for i, e in state:
            if i < left and matches >> i & 1:
                out.add((i + 1, e))
            if e < limit:
                out.add((i, e + 1))
                if i < left:
                    out.add((i + 1, e + 1))
        known = _STEPS[key] = closed(out, left, limit)
    return known


_STARTS = {k: closed({(0, 0)}, k, k)[1] for k in (1, 2)}


class Node:
    """A node of the trie: the terms below it are the numbers from its place
    up to ``stop``; ``end`` is the number of the term that ends here, or -1."""

    __slots__ = ("children", "stop", "end")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.stop, self.end = 0, -1


def trie(names: list[str]) -> Node:
    """Trie of terms given in order."""
    root = Node()
    for number, name in enumerate(names):
        node = root
        node.stop = number + 1
        for letter in name:
            node = node.children.setdefault(letter, Node())
            node.stop = number + 1
        node.end = number
    return root


#: Cells of a table of words and terms that are compared at once.
CELLS = 1 << 20


class Lexicon:
    """Trie of weighted terms with approximate lookup."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        names = sorted(terms)
        self.limits = np.array([max_distance(len(t)) for t in names], np.int64)
        self.lengths = np.array([len(t) for t in names], np.int64)
        self.bits = np.concatenate([signatures([t]) for t in names], axis=1) if names else np.zeros((3, 0), np.uint64)
        self.names, self.root = names, trie(names)
        self.memo = Memo(self.find)

    def candidates(self, words: list[str]) -> list[list[int]]:
        """Per word (all of one length) the numbers of the terms whose length,
        letters and letter pairs allow them to be near, ascending; every term that
        is near is among them.  The walk leaves out branches without any."""
        fit = np.flatnonzero(np.abs(self.lengths - len(words[0])) <= self.limits)
        out: list[list[int]] = [[] for _ in words]
        if not len(fit):
            return out
        # The difference in length takes insertions or deletions, which change
        # one letter bit and three pair bits instead of two and four.
        limit, longer, rows = self.limits[fit], np.abs(self.lengths[fit] - len(words[0])), max(1, CELLS // len(fit))
        for at in range(0, len(words), rows):
            apart = np.bitwise_count(signatures(words[at:at + rows])[:, :, None] ^ self.bits[:, None, fit])
            near = (apart[0] <= 2 * limit - longer) & (apart[1] + apart[2] <= 4 * limit - longer)
            for row, k in zip(*(z.tolist() for z in np.nonzero(near))):
                out[at + row].append(int(fit[k]))
        return out

    def prepare(self, words: set[str]) -> None:
        """Look up many words at once, for the memo."""
        memo = self.memo
        by_length: dict[int, list[str]] = {}
        for word in words:
            if word not in memo and word not in memo.old and 3 <= len(word) <= MEMO_PIECE and word not in self.terms:
                by_length.setdefault(len(word), []).append(word)
        for group in by_length.values():
            for word, wanted in zip(group, self.candidates(group)):
                memo.store(word, self.walk(word, wanted) if wanted else ())

    def find(self, word: str) -> tuple:
        """(term, distance) of the nearest term, heaviest and then first in
        order on ties; () if none is near."""
        if word in self.terms:
            return word, 0
        wanted = self.candidates([word])[0] if len(word) >= 3 else []
        return self.walk(word, wanted) if wanted else ()

    def walk(self, word: str, wanted: list[int]) -> tuple:
        """The intersection of the automaton of a word with the trie.

        Both are walked together from their roots: a child is entered if it
        leads to a ``wanted`` term and the automaton has a state for its letter.
        """
        n, limit = len(word), 1 if len(word) < 7 else 2
        width = 2 * limit + 1
        window = (1 << width) - 1
        masks: dict[str, int] = {}
        for i, letter in enumerate(word):
            masks[letter] = masks.get(letter, 0) | 1 << i
        seen = masks.get
        found = []
        # Before any letter: up to ``limit`` letters of the word may be skipped.
        todo = [(self.root, 0, 0, _STARTS[min(n, limit)], 0, len(wanted))]
        while todo:
            node, depth, offset, state, a, b = todo.pop()
            if node.end == wanted[a]:
                term = self.names[node.end]
                d = min((e for i, e in state if offset + i == n), default=9)
                if d <= max_distance(len(term)):
                    found.append((d, -self.terms[term], term))
                a += 1
            if b - a == 1:  # a single term is left: its path to the end
                term = self.names[wanted[a]]
                for letter in term[depth:]:
                    left = n - offset
                    moved, state = step(state, seen(letter, 0) >> offset & window, left if left < width else width, limit)
                    if not state:
                        break
                    offset += moved
                else:
                    d = min((e for i, e in state if offset + i == n), default=9)
                    if d <= max_distance(len(term)):
                        found.append((d, -self.terms[term], term))
                continue
            left = n - offset
            while a < b:
                letter = self.names[wanted[a]][depth]
                child = node.children[letter]
                after = bisect_left(wanted, child.stop, a, b)
                moved, reached = step(state, seen(letter, 0) >> offset & window, left if left < width else width, limit)
                if reached:
                    todo.append((child, depth + 1, offset + moved, reached, a, after))
                a = after
        if not found:
            return ()
        d, _, term = min(found)
        return term, d


_WORDS = regex.compile(WORD)


def quoted(text: str, start: int, end: int, words: list[str], i: int) -> bool:
    """Is the hit a mention: quotation marks on both sides nearby, or a
    reporting word in the window before it?"""
    if not REPORTING.isdisjoint(words[max(0, i - WINDOW):i]):
        return True
    left, right = text[max(0, start - 40):start], text[end:end + 40]
    left, right = left.rpartition("\n")[2], right.partition("\n")[0]
    return any(c in QUOTES for c in left) and any(c in QUOTES for c in right)


FEATURES = 6


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Hit features of one text."""
    low = text.lower()
    return hit_features(low, _WORDS.findall(low), lexicon)


def batch_features(texts: list[str | None], lexicon: Lexicon):
    """Hit features of many texts; their words are looked up together."""
    lows = [(t or "").lower() for t in texts]
    words = [_WORDS.findall(low) for low in lows]
    lexicon.prepare(set().union(*words))
    return [hit_features(low, w, lexicon) for low, w in zip(lows, words)]


def hit_features(low: str, words: list[str], lexicon: Lexicon) -> list[float]:
    hits = [(i, m) for i, m in enumerate(map(lexicon.memo.__getitem__, words)) if m]
    if not hits:
        return [0.0] * FEATURES
    spans = None
    total = exact = fuzzy = mentions = 0.0
    best, distinct = 0.0, set()
    for i, (term, d) in hits:
        weight = lexicon.terms[term] * (1.0 if d == 0 else FUZZY_WEIGHT / d)
        if any(c in low for c in QUOTES) or not REPORTING.isdisjoint(words[max(0, i - WINDOW):i]):
            if spans is None:
                spans = [m.span() for m in _WORDS.finditer(low)]
            if quoted(low, *spans[i], words, i):
                weight *= QUOTED_WEIGHT
                mentions += 1
        total += weight
        best = max(best, weight)
        distinct.add(term)
        exact += d == 0
        fuzzy += d > 0
    n = len(words)
    return [best, math.log1p(total), math.log1p(exact), math.log1p(fuzzy), math.log1p(len(distinct)) - 0.5 * math.log1p(mentions),
            100.0 * total / (n + 50)]


def held_out(doc_id: Column) -> Column:
    """Is a row held out, by the crc32 of its id as text?"""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
    return F.coalesce(rest == HELD_OUT, F.lit(False))


def training_labels(labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from; a document is
    toxic if any of its labels says so."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") == 1).cast("int").alias("toxic")
    )
    own = materialize(own, "toxicity-labels")
    share = min(1.0, max_labelled / max(1, own.count()))
    return own.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 40)) < int(share * (1 << 40)))


def learn_lexicon(sample: DataFrame, min_docs: int, min_odds: float, sureness: float) -> dict[str, float]:
    """Term -> weight of every word that marks toxic documents.

    The weight is a lower bound of the log-odds: ``sureness`` standard errors
    below them.  A word counts from ``min_docs`` toxic documents on, or one in a
    thousand of them if that is more.  The words are those of the bounded sample.
    """
    n = sample.groupBy().agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = n[0] or 0, n[1] - (n[0] or 0)
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    counts = sample.select(F.explode(words).alias("word"), "toxic").groupBy("word").agg(
        F.sum("toxic").alias("t"), F.count("*").alias("n")
    )
    t, rest = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(t / (toxic + 1.0)) - F.log(rest / (clean + 1.0)) - sureness * F.sqrt(1 / t + 1 / rest)
    known = counts.filter((F.col("t") >= max(min_docs, -(-toxic // 1000))) & (F.char_length("word") >= 3))
    rows = known.select("word", F.round(odds, 6).alias("odds")).filter(F.col("odds") >= min_odds).collect()
    return {r.word: r.odds for r in sorted(rows)}


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (bias last) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Scorer:
    def __init__(self, terms: dict[str, float], beta: list[float] | None):
        self.lexicon, self.beta = Lexicon(terms), beta

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.beta is None:
            return [0.0] * len(texts)
        sums = (sum(b * v for b, v in zip(self.beta, [*x, 1.0])) for x in batch_features(texts, self.lexicon))
        return [round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 9) for z in sums]


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, min_docs: int = 4,
    min_odds: float = 2.0, sureness: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[dict[str, float], list[float] | None]:
    """(lexicon, coefficients) learned from labelled rows that are not held out."""
    known = training_labels(labels, max_labelled)
    sample = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-sample",
    )
    terms = learn_lexicon(sample, min_docs, min_odds, sureness)
    if not terms:
        return {}, None

    def run(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            x = batch_features(batch.column(0).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    return terms, [float(b) for b in fit_logistic(x, rows.column("toxic").to_numpy().astype(np.float64))]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col=id_col, text_col=text_col, **fit_options))
    schema = doc_fields(
        docs, id_col, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
    )

    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=schema.names,
            )

    return docs.select(id_col, text_col, held_out(F.col(id_col))).mapInArrow(run, schema)
