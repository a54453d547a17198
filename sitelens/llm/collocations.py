"""Phrase collocation mining over sorted count streams.

Texts are cut into pieces at ``. , ; : ! ?`` and line breaks, pieces into words
(A-Z lower-cased), all per language.  Phrases of 2 to ``max_words`` words that
occur ``min_count`` times or more are candidates.  A candidate ``a`` times cut
into a first part (``l`` times) and a rest (``r`` times) scores
``floor(2000000 * a / (l + r))``; its lowest cut counts.  A candidate is
dropped if a longer one that contains it occurs at least 80 % as often.

Counts are streams of (lang, phrase, count), laid out as in external
estimation of n-gram models: written once in prefix order (by a phrase without
its last word) and once in suffix order (without its first word).  Sort-merge
joins walk them in lockstep with the phrase stream:

* the prefix stream gives each phrase its most frequent extension to the
  right, the suffix stream that to the left.  A phrase in a longer candidate
  also lies in the candidate one word longer between them, which is at least
  as frequent, so these two decide whether it is dropped;
* the cuts, in order of their first parts, meet the phrase stream for ``l``,
  and in order of their rests for ``r``.

Counting goes by length: words first, then pairs, then longer phrases, each
only where all parts one step shorter are frequent (they must be, if the
phrase is).  Pairs of frequent words are first summed by their 64-bit hash (a
sum is never below the count of any of its pairs), which keeps the strings of
rare pairs out of the shuffle.  Frequent words and pairs reach the scan as a
filter of fixed size that never misses one; what passes by chance is counted
too and falls at ``min_count``, so all counts are exact and by string.  Every
task combines its occurrences before the shuffle.

Defined results: a null or empty text has no words; a null lang is ``und``
(and counts with documents of that lang); repeated rows count as often as they
occur; equal scores by count descending, then phrase ascending by UTF-8 bytes;
a lang without candidates has no rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.keyfilter import contains, filter_bits, filter_words, hash_filter, key_filter, key_hashes
from sitelens.llm.common import materialize

#: Words a task counts at once (a memory bound).
TASK_WORDS = 4_000_000
SCHEMA = "lang string, phrase string, c long"

#: A-Z is lower-cased; the separators of pieces become line feeds.
_PIECES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


class Words(dict):
    """The words of one lang, numbered from 1, and the text so far as their
    numbers with a 0 after every piece."""

    def __init__(self):
        super().__init__()
        self.text = array("i")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n

    def add(self, text: str) -> None:
        # split() knows space, tab and the line breaks, which pieces no longer hold.
        for piece in text.encode("utf-8").translate(_PIECES).split(b"\n"):
            words = piece.split()
            if words:
                self.text.extend(map(self.__getitem__, words))
                self.text.append(0)

    def numbers(self) -> np.ndarray:
        return np.frombuffer(self.text, np.int32).astype(np.int64)

    def hashes(self, lang: str) -> np.ndarray:
        """By number; the lang is part of a word here (0 has none)."""
        start = lang.encode("utf-8") + b"\t"
        return np.concatenate((np.zeros(1, np.uint64), key_hashes(start + w for w in self)))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(17) | b >> np.uint64(47))


def _frequent_pairs(words: Words, lang: str, word_filter: np.ndarray):
    """(text, hashes, positions of pairs of words that the filter knows)."""
    text, h = words.numbers(), words.hashes(lang)
    known = contains(word_filter, h)
    known[0] = False
    ok = known[text]
    return text, h, np.flatnonzero(ok[:-1] & ok[1:])


def _count_words(words: Words, lang: str):
    """Counts of all words, and of the phrase null: occurrences in all."""
    counts = np.bincount(words.numbers(), minlength=len(words) + 1)[1:]
    yield _rows(lang, [*words, None], np.append(counts, counts.sum()))


def _count_pair_hashes(words: Words, lang: str, word_filter: np.ndarray):
    text, h, at = _frequent_pairs(words, lang, word_filter)
    pairs, counts = np.unique(text[at] * len(h) + text[at + 1], return_counts=True)
    both = _pair_hash(h[pairs // len(h)], h[pairs % len(h)])
    yield pa.RecordBatch.from_arrays([pa.array(both.view(np.int64)), pa.array(counts, pa.int64())], names=["h", "c"])


def _count_phrases(words: Words, lang: str, word_filter: np.ndarray, pair_filter: np.ndarray, max_words: int):
    """Counts of the phrases of 2 words and more all whose pairs the filter knows."""
    text, h, at = _frequent_pairs(words, lang, word_filter)
    at = at[contains(pair_filter, _pair_hash(h[text[at]], h[text[at + 1]]))]
    names = [b"", *words]
    # Phrases by the position of their first word; m + 1 words from those of m words and the pair at their end.
    link = np.zeros(len(text), bool)
    link[at] = True
    distinct, own = np.unique(text[at] * len(h) + text[at + 1], return_inverse=True)
    phrases = [names[a] + b" " + names[b] for a, b in zip((distinct // len(h)).tolist(), (distinct % len(h)).tolist())]
    for m in range(2, max_words + 1):
        if not len(at):
            return
        yield _rows(lang, phrases, np.bincount(own, minlength=len(phrases)))
        more = (at + m < len(text)) & link[np.minimum(at + m - 1, len(text) - 1)]
        at, own = at[more], own[more]
        distinct, own = np.unique(own * len(h) + text[np.minimum(at + m, len(text) - 1)], return_inverse=True)
        phrases = [phrases[a] + b" " + names[b] for a, b in zip((distinct // len(h)).tolist(), (distinct % len(h)).tolist())]


def _rows(lang: str, phrases: list, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(lang, len(phrases)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
        names=["lang", "phrase", "c"],
    )


def _counted(docs: DataFrame, count, schema: str, task_words: int) -> DataFrame:
    """The rows of ``count(words, lang)`` for bounded runs of the texts."""

    def run(batches):
        langs: dict[str, Words] = {}

        def flush():
            for lang, words in langs.items():
                if len(words):
                    yield from count(words, lang)
            langs.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                langs.setdefault(lang, Words()).add(text or "")
                if len(langs[lang].text) >= task_words:
                    yield from flush()
            if sum(len(w.text) for w in langs.values()) >= task_words:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, schema)


def count_streams(
    docs: DataFrame, max_words: int, min_count: int, lang_col: str = "lang", text_col: str = "text", task_words: int = TASK_WORDS,
):
    """(frequent phrases of 1 to ``max_words`` words with counts; occurrences
    of all words per lang)."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    often, total = F.col("c") >= min_count, F.sum("c").alias("c")

    def summed(count):
        return _counted(own, count, SCHEMA, task_words).groupBy("lang", "phrase").agg(total)

    words = materialize(summed(_count_words).filter(F.col("phrase").isNull() | often), "phrase-words")
    totals = words.filter("phrase IS NULL").select("lang", F.col("c").alias("n"))
    words = words.filter("phrase IS NOT NULL")
    bits = filter_bits(words.count())
    known = key_filter(words.select(F.concat_ws("\t", "lang", "phrase").alias("k")), "k", bits)
    word_filter = spark.sparkContext.broadcast(filter_words(known))
    hashes = _counted(own, lambda w, lang: _count_pair_hashes(w, lang, word_filter.value), "h long, c long", task_words)
    hashes = materialize(hashes.groupBy("h").agg(total).filter(often).select("h"), "phrase-pair-hashes")
    pair_filter = spark.sparkContext.broadcast(filter_words(hash_filter(hashes, "h", filter_bits(hashes.count()))))
    longer = summed(lambda w, lang: _count_phrases(w, lang, word_filter.value, pair_filter.value, max_words)).filter(often)
    return words.unionByName(materialize(longer, "phrase-streams")), totals


def collocations(
    docs: DataFrame, max_words: int = 4, min_count: int = 30, top: int = 2000, absorb: int = 80,
    lang_col: str = "lang", text_col: str = "text", task_words: int = TASK_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` candidates of every
    lang that no longer candidate with ``absorb`` % of the count contains."""
    streams, totals = count_streams(docs, max_words, min_count, lang_col, text_col, task_words)
    grams = streams.withColumn("m", F.size(F.split("phrase", " ")))
    long_ones = grams.filter("m > 1")
    # Prefix order: by the phrase without its last word; suffix order: by the one without its first.
    head = materialize(
        long_ones.select("lang", F.expr("substring_index(phrase, ' ', m - 1)").alias("phrase"), "c")
        .groupBy("lang", "phrase").agg(F.max("c").alias("right_c")).sortWithinPartitions("lang", "phrase"), "phrase-prefix")
    tail = materialize(
        long_ones.select("lang", F.expr("substring_index(phrase, ' ', 1 - m)").alias("phrase"), "c")
        .groupBy("lang", "phrase").agg(F.max("c").alias("left_c")).sortWithinPartitions("lang", "phrase"), "phrase-suffix")
    key = ["lang", "phrase"]
    reach = F.coalesce(F.greatest("right_c", "left_c"), F.lit(0)).cast("decimal(38,0)")
    candidates = (
        long_ones.join(head.hint("merge"), key, "left").join(tail.hint("merge"), key, "left")
        .filter(reach * 100 < F.col("c").cast("decimal(38,0)") * absorb)
        .select("lang", "phrase", "m", F.col("c").alias("a"))
    )
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - m)").alias("rest"),
    )
    left = streams.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l"))
    right = streams.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r"))
    scored = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"]).withColumn(
        "score", F.expr("CAST(2000000 * CAST(a AS DECIMAL(30,0)) DIV (CAST(l AS DECIMAL(20,0)) + r) AS BIGINT)")
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
