"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
operations only.

A benchmark item becomes its windows of ``window`` consecutive words (an item
of fewer words is one window).  A window is a set of word shingles, and it
occurs in a document only if all of them do, so one shingle per window is a
sufficient prefix: the rarest one, by its count over the whole corpus.

1. Count every benchmark shingle over all documents (map-side join, partial
   aggregate); windows with a shingle that never occurs are out.
2. Join the documents' shingles with the windows' rarest shingles, keep the
   positions that pass the bounds (the window must begin and end inside the
   document), and compare the words of the whole window exactly.
3. Merge the hit intervals of each document and list its items.

The window table is broadcast only when it has at most ``broadcast_rows``
rows; beyond that the shingles are shuffled to it, and the words of the
candidates are joined back for the exact comparison.

Defined results: a null text has no words (never contaminated); a null
benchmark text is no item; hits of items with a null id count, but such items
are not listed; items with the same id count once; repeated rows give
repeated results; empty tables give empty results or clean documents; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import UPPER, materialize

#: Characters between words (after lower-casing A-Z).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(col) -> Column:
    """Words of a text: lower-cased A-Z, digits, a-z and everything beyond
    ASCII; no words for null."""
    low = F.translate(col, UPPER, UPPER.lower())
    return F.coalesce(F.array_remove(F.split(low, GAP), ""), F.array().cast("array<string>"))


def _shingle_key(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at`` (0-based) on."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(wid, w, m) distinct windows with their words and length, and (wid,
    item_id) which items have them."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(text_col).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = items.select("item_id", "words", F.explode(starts).alias("s")).select(
        "item_id", F.slice("words", F.col("s") + 1, F.lit(window)).alias("w")
    )
    cut = materialize(cut.withColumn("wid", F.md5(F.concat_ws(" ", "w"))), "decontam-windows")
    distinct = cut.groupBy("wid").agg(F.first("w").alias("w")).withColumn("m", F.size("w"))
    return distinct, cut.select("wid", "item_id").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, k, offset, key): the shingles of each window; windows of fewer
    than ``shingle`` words have one, the whole window."""
    k = F.least("m", F.lit(shingle))
    spread = windows.withColumn("k", k).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("k"))))
    key = reduce(
        lambda other, size: F.when(F.col("k") == size, _shingle_key(F.col("w"), F.col("offset"), size)).otherwise(other),
        range(1, shingle + 1), F.lit(None).cast("long"),
    )
    return spread.select("wid", "k", "offset", key.alias("key"))


#: Key of the row that stands for the document itself (position -1).
_SELF = -1


def document_shingles(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every document: the columns of ``texts`` and at, k,
    key; one more row per document has at = -1 and k = 0."""
    at = F.col("at")
    spread = texts.withColumn("at", F.explode(F.sequence(F.lit(_SELF), F.size("words") - 1)))
    own = (F.lit(0), F.lit(0).cast("long"))
    if len(sizes) == 1:
        key = _shingle_key(F.col("words"), at, sizes[0])
        return spread.select(
            "*", F.when(at < 0, own[0]).otherwise(sizes[0]).alias("k"), F.when(at < 0, own[1]).otherwise(key).alias("key")
        )
    pair = lambda k, key: F.struct(k.alias("k"), key.alias("key"))
    keys = F.array(*[pair(F.lit(size), _shingle_key(F.col("words"), at, size)) for size in sizes])
    return spread.select("*", F.explode(F.when(at < 0, F.array(pair(*own))).otherwise(keys)).alias("x")).select(
        *spread.columns, F.col("x.k").alias("k"), F.col("x.key").alias("key")
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    shingle: int = 5,
    share: float = 0.05,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), n_words,
    n_hit, n_items, item_ids (sorted strings), contaminated (some hit and at
    least ``share`` of the words hit)."""
    windows, members = item_windows(benchmark, window, item_id_col, item_text_col)
    windows = materialize(windows, "decontam-distinct")
    tokens = materialize(window_shingles(windows, shingle), "decontam-shingles")
    sizes = sorted(r[0] for r in tokens.select("k").distinct().collect()) or [shingle]
    small = tokens.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)

    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), words_of(text_col).alias("words")
    )
    shingles = document_shingles(texts, sizes)

    # 1. Rarity over the whole corpus.
    counts = materialize(
        shingles.select("k", "key").join(hint(tokens.select("k", "key").distinct()), ["k", "key"]).groupBy("k", "key").count(),
        "decontam-counts",
    )
    ranked = tokens.join(counts, ["k", "key"], "left").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "key", "offset", "k")).alias("rare")
    )
    prefix = ranked.filter("rare.n > 0").join(windows, "wid").select("wid", "w", "m", "rare.k", "rare.key", "rare.offset")
    prefix = materialize(prefix, "decontam-prefix")

    # 2. Prefix join, position bounds, exact comparison.  The document's own
    # row meets a window without words, so one pass gives counts and hits.
    own_row = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("wid"), F.array().cast("array<string>").alias("w"), F.lit(0).alias("m"),
        F.lit(0).alias("k"), F.lit(0).cast("long").alias("key"), F.lit(_SELF).alias("offset"),
    )
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("m") <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("m")) == F.col("w")
    if small:
        found = shingles.join(F.broadcast(prefix.unionByName(own_row)), ["k", "key"]).filter(
            ((F.col("at") < 0) & F.col("wid").isNull()) | ((F.col("at") >= 0) & F.col("wid").isNotNull() & fits & same)
        ).select("doc_id", "text_key", F.size("words").alias("n_words"), start.alias("start"), "m", "wid")
    else:
        near = (
            shingles.select("doc_id", "text_key", F.size("words").alias("n"), "at", "k", "key")
            .join(prefix, ["k", "key"])
            .filter((start >= 0) & (start + F.col("m") <= F.col("n")))
            .select("doc_id", "text_key", start.alias("start"), "m", "wid", "w")
            .distinct()
        )
        back = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "words").distinct()
        hits = near.join(back, near["doc_id"].eqNullSafe(back["d"]) & (near["text_key"] == back["t"])).filter(
            F.slice("words", F.col("start") + 1, F.col("m")) == F.col("w")
        )
        found = texts.select(
            "doc_id", "text_key", F.size("words").alias("n_words"), F.lit(0).alias("start"), F.lit(0).alias("m"),
            F.lit(None).cast("string").alias("wid"),
        ).unionByName(hits.select("doc_id", "text_key", F.size("words").alias("n_words"), "start", "m", "wid"))
    found = materialize(found, "decontam-found")

    # 3. Words hit (union of intervals) and items per document.
    own = found.filter("wid IS NULL").select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"))
    hits = found.filter("wid IS NOT NULL").select("doc_id", "text_key", "start", (F.col("start") + F.col("m")).alias("end"), "wid")
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = hits.withColumn("new", F.greatest(F.col("end") - reach, F.lit(0))).groupBy("doc_id", "text_key").agg(
        F.sum("new").cast("long").alias("n_hit")
    )
    listed = (
        hits.select("doc_id", "text_key", "wid").distinct().join(members, "wid").filter("item_id IS NOT NULL")
        .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    for part in (covered, listed):
        part = part.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
        own = own.join(part, own["doc_id"].eqNullSafe(part["d"]) & (own["text_key"] == part["t"]), "left").drop("d", "t")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return own.select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"), ((n_hit > 0) & (n_hit >= F.lit(share) * F.col("n_words"))).alias("contaminated"),
    )
