"""Quality rules: base counts of every text and a hashed n-gram
log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into ``2 ** bits`` buckets.  One pass
over the whole corpus counts the buckets of all documents (raw) and of the
trusted documents (target); counts are combined per task and summed with a
partial aggregate, so the shuffle grows with the number of tasks and no key
is hot.  The model is the log ratio of the two smoothed multinomials, a fixed
number of floats.  A document's score is the summed ratio of its n-grams
divided by their number; every document is kept exactly when it passes the
base rules and its score reaches one threshold.

Labels: three quarters of the labelled documents give the target, the last
quarter the threshold, all of them however many there are.  The threshold is
exact: the held-out scores are counted per distinct score, ranges of scores
get the counts below them as prefix sums, and the cheapest cut is a minimum
over the rows.  Up to ``broadcast_ids`` ids of either kind are broadcast to
their pass; beyond that a shuffled semi join picks the trusted texts, and the
held-out ids meet the scores of all texts.  Labels are used by id only.

Defined results: a null text has no words and is rejected; repeated rows give
repeated results; rows with a null id are scored but never trusted; an empty
table gives an empty result; without trusted documents the ratio is zero
everywhere and only the base rules decide.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.ordering import keyed_prefix_sums
from sitelens.llm.common import doc_fields, materialize

#: Buckets are 2 ** BITS.
BITS = 18
#: Most trusted ids, and most held-out ids, that are broadcast.
BROADCAST_IDS = 2_000_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list) -> int:
    """Words covered by 5-word windows that occur twice or more."""
    if len(words) < 6:
        return 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, w in enumerate(windows) if times[w] > 1])
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 5, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def base_counts(text: str, words: list) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif not line.isspace() and line or line.encode("utf-8").split():
            seen.add(line)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicates, repeated_words(words),
    )


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").split()  # bytes: space and \t \n \v \f \r only


def buckets(words: list[bytes], bits: int) -> np.ndarray:
    """Bucket numbers of all word unigrams and bigrams."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    pairs = (h[:-1] * _MIX) ^ (h[1:] + (h[:-1] >> np.uint64(29)))
    shift = np.uint64(64 - bits)
    return (np.concatenate((h, pairs * _MIX)) >> shift).astype(np.int64)


def bucket_counts(
    docs: DataFrame, trusted: DataFrame, bits: int, id_col: str, text_col: str, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the
    trusted ones (doc_id, distinct)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches, again=False):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = buckets(words_of(text or ""), bits)
                if len(b) > 1 << (bits - 2):
                    raw += (c := np.bincount(b, minlength=1 << bits))
                    if mark:
                        target += c
                else:
                    np.add.at(raw, b, 1)
                    if mark:
                        np.add.at(target, b, 1)
        full = np.flatnonzero(raw)
        for at in range(0, len(full), 1 << 14):
            part = full[at:at + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(raw[part] * (not again)), pa.array(target[part])],
                names=["bucket", "raw", "target"],
            )

    schema = "bucket int, raw long, target long"
    if trusted.count() <= broadcast_ids:
        marked = own.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left")
        parts = marked.select("text", "trusted").mapInArrow(run, schema)
    else:
        # All texts are counted where they are; only the trusted ones meet their ids.
        chosen = own.join(trusted.select("doc_id").hint("shuffle_merge"), "doc_id", "left_semi")
        parts = own.select("text", F.lit(False).alias("trusted")).mapInArrow(run, schema).unionByName(
            chosen.select("text", F.lit(True).alias("trusted")).mapInArrow(lambda batches: run(batches, again=True), schema)
        )
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame, bits: int, smoothing: float = 0.5) -> np.ndarray:
    """Log ratio of every bucket (a fixed number of rows is fetched)."""
    table = counts.toArrow()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    at = table.column("bucket").to_numpy()
    raw[at], target[at] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    share = (target + smoothing) / (target.sum() + smoothing * len(target))
    return (np.log(share) - np.log((raw + smoothing) / (raw.sum() + smoothing * len(raw)))).astype(np.float32)


def score_of(words: list[bytes], ratio: np.ndarray, bits: int) -> float:
    """Length-normalised log-likelihood ratio (0 for a text without words)."""
    if not words:
        return 0.0
    got = ratio[buckets(words, bits)]
    return float(np.round(got.astype(np.float64).sum() / len(got), 9))


def labelled_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, good, fold) of every labelled document.  A document is good
    only if all its labels say so."""
    per_doc = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good")
    ).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)))
    return materialize(per_doc, "quality-labels")


def labelled_sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """All labelled documents, but of fold 0 at most about ``max_labelled``,
    chosen by a hash of the id; only for callers that ask for a bound."""
    per_doc = labelled_documents(labels)
    share = min(1.0, max_labelled / max(1, per_doc.filter("fold = 0").count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 40))
    return per_doc.filter((F.col("fold") > 0) | (place < int(share * (1 << 40))))


def best_threshold(scores: np.ndarray, good: np.ndarray, clean_cost: float = 8.0) -> float:
    """Threshold with the least weighted error: rejecting a good document
    costs ``clean_cost`` times what keeping a poor one costs, as shares of
    each class.  Midpoint between the scores on both sides; lowest on ties."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(np.float64)
    lost = np.concatenate(([0.0], np.cumsum(g))) / g.sum()
    caught = np.concatenate(([0.0], np.cumsum(1 - g))) / (1 - g).sum()
    cuts = np.concatenate(([-np.inf], (s[1:] + s[:-1]) / 2, [np.inf]))
    real = np.concatenate(([True], s[1:] > s[:-1], [True]))
    cost = np.where(real, clean_cost * lost - caught, np.inf)
    return float(cuts[int(np.argmin(cost))])


def exact_threshold(scores: DataFrame, clean_cost: float = 8.0) -> float:
    """``best_threshold`` of the rows (score, good) of a table of any size."""
    marks = {"good": F.col("good"), "poor": ~F.col("good")}
    distinct = scores.groupBy("score").agg(*[F.sum(c.cast("long")).alias(x) for x, c in marks.items()])
    distinct = materialize(distinct, "held-scores")
    total = distinct.agg(F.sum("good").alias("good"), F.sum("poor").alias("poor")).first()
    if not total.good or not total.poor:
        return float("-inf")
    below = keyed_prefix_sums(distinct, [], ["score"], {f"{x}_below": F.col(x) for x in marks})
    lost, caught = (F.col(f"{x}_below").cast("double") / F.lit(float(total[x])) for x in marks)
    best = below.agg(F.min(F.struct((F.lit(clean_cost) * lost - caught).alias("cost"), "score")).alias("b")).first().b
    if clean_cost - 1.0 < best.cost:
        return float("inf")
    lower = distinct.filter(F.col("score") < best.score).agg(F.max("score")).first()[0]
    return float("-inf") if lower is None else (best.score + lower) / 2


def held_out_scores(
    docs: DataFrame, held: DataFrame, model, bits: int, id_col: str, text_col: str, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """(score, good) of every row of ``docs`` that ``held`` (doc_id, good) names."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            scores = [score_of(words_of(t or ""), model.value, bits) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()), batch.column(1)], names=["score", "key"])

    if held.count() <= broadcast_ids:
        chosen = own.join(F.broadcast(held), "doc_id")
        return chosen.select("text", F.col("good").alias("key")).mapInArrow(run, "score double, key boolean").withColumnRenamed("key", "good")
    # All texts are scored where they are; only scores meet the ids.
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("key", own.schema["doc_id"].dataType)])
    scored = own.select("text", "doc_id").mapInArrow(run, schema).withColumnRenamed("key", "doc_id")
    return scored.join(held.hint("shuffle_merge"), "doc_id").select("score", "good")


def fit(
    docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", broadcast_ids: int = BROADCAST_IDS,
):
    """(log ratio per bucket, threshold); ``max_labelled`` bounds the
    documents behind the threshold, by default all held-out ones count."""
    marked = labelled_documents(labels) if max_labelled is None else labelled_sample(labels, max_labelled)
    trusted = marked.filter("good AND fold > 0").select("doc_id")
    ratio = log_ratio(bucket_counts(docs, trusted, bits, id_col, text_col, broadcast_ids), bits)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    held = marked.filter("fold = 0").select("doc_id", "good")
    return ratio, exact_threshold(held_out_scores(docs, held, model, bits, id_col, text_col, broadcast_ids))


def quality_rules(
    docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", columns: list[str] | None = None, broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, score,
    kept.  ``columns`` are passed through behind them (for filters)."""
    ratio, threshold = fit(docs, labels, bits, max_labelled, id_col, text_col, broadcast_ids)
    model = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = [T.StructField(f"in_{i}", docs.schema[c].dataType) for i, c in enumerate(columns or [])]
    schema = doc_fields(
        docs, id_col, *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()), *extra,
    )

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            counts, failed, scores = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = words_of(text)
                row = base_counts(text, words)
                counts.append(row)
                failed.append(row[0] < 10 or 100 * row[4] > 20 * row[0])
                scores.append(score_of(words, model.value, bits))
            kept = [not f and s >= threshold for f, s in zip(failed, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(failed, pa.bool_()),
                 pa.array(scores, pa.float64()), pa.array(kept, pa.bool_()), *batch.columns[2:]],
                names=schema.names,
            )

    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        *[F.col(c).alias(f"in_{i}") for i, c in enumerate(columns or [])],
    )
    return source.mapInArrow(run, schema)
