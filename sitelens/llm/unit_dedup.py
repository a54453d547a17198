"""Substring dedup by line hashing.

Units are the lines of a text (or its paragraphs) and, inside them, the
sentences of at least ``min_sentence`` words, so a passage that sits in the
middle of a longer line is found by its whole sentences.  With ``windows``
(the registered query) the clauses of a text are units too: those of
``min_sentence`` words or more, and for every shorter one the runs of
neighbouring clauses to its left and right that are just long enough, so a
short sentence is removed only together with a neighbour that repeats with it
in the same earlier place.  A unit is
normalised (lower case, runs of white space as one space, ends trimmed) and
hashed to 128 bits; units without a word are left alone.  The units of a text
are one row of arrays.  The first halves of all digests are counted; only units
whose half repeats go on, and their whole digests are grouped over the corpus
with a partial aggregate that keeps the earliest occurrence by (doc_id,
start); all later occurrences are removed, with their offsets in the original
text (code points, end exclusive).

The digest of a very common line is a hot key: the aggregate combines it on
the map side, and the join that marks its occurrences carries only digests
seen twice or more and is split by adaptive skew handling.  Texts do not
cross a shuffle unless the kept texts are asked for.

Defined results: a null or empty text has no units; the earliest occurrence
may be in the same text; rows that repeat both id and text count as one
occurrence and get the same result; rows with a null id rank last; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.keyfilter import filter_bits, hash_filter, may_contain_hash
from sitelens.llm.common import materialize

_PIECES = {"line": regex.compile(r"[^\n]+"), "paragraph": regex.compile(r"(?:[^\n]|\n(?!\s*\n))+")}
_SENTENCE = regex.compile(r"\S[^.!?]*(?:[.!?](?!\s|$)[^.!?]*)*(?:[.!?]+(?=\s|$))?")
_CLAUSE = regex.compile(r"\S[^,;:]*(?:[,;:](?!\s|$)[^,;:]*)*(?:[,;:]+(?=\s|$))?")


def normalise(unit: str) -> str:
    return " ".join(unit.lower().split())


def windows_of(text: str, sentences: list, min_words: int) -> set[tuple[int, int]]:
    """Spans of the clauses of at least ``min_words`` words and, for every
    shorter one, of the runs of clauses to its left and to its right that are
    just long enough."""
    parts = [c.span() for s in sentences for c in _CLAUSE.finditer(text, s.start(), s.end())]
    sizes = [len(text[a:b].split()) for a, b in parts]
    out = set()
    for i, n in enumerate(sizes):
        left = right = i
        total = n
        while total < min_words and right + 1 < len(parts):
            right += 1
            total += sizes[right]
        if total >= min_words:
            out.add((parts[i][0], parts[right][1]))
        if n < min_words:
            while n < min_words and left > 0:
                left -= 1
                n += sizes[left]
            if n >= min_words:
                out.add((parts[left][0], parts[i][1]))
    return out


def units_of(text: str, unit: str = "line", min_sentence: int = 8, windows: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of the units of a text."""
    out = []
    for m in _PIECES[unit].finditer(text):
        whole = normalise(m.group())
        if not whole:
            continue
        out.append((m.start(), m.end(), whole))
        inner = [s for s in _SENTENCE.finditer(text, m.start(), m.end())] if min_sentence else []
        if len(inner) > 1:
            for s in inner:
                part = normalise(s.group())
                if part.count(" ") >= min_sentence - 1:
                    out.append((s.start(), s.end(), part))
        if windows and inner:
            known = {(m.start(), m.end())} | {(s.start(), s.end()) for s in inner if len(inner) > 1}
            out += [(a, b, normalise(text[a:b])) for a, b in sorted(windows_of(text, inner, min_sentence) - known)]
    return out


def unit_table(docs: DataFrame, unit: str, min_sentence: int, id_col: str, text_col: str, windows: bool = False) -> DataFrame:
    """(doc_id, text_key, n_units, start, end, hi, lo): one row per text, its
    units and their digests as arrays."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("n_units", T.LongType()),
        *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("start", "end")],
        *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("hi", "lo")],
    ])

    def run(batches):
        for batch in batches:
            starts, ends, digests, offsets = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                found = units_of(text or "", unit, min_sentence, windows)
                starts += [u[0] for u in found]
                ends += [u[1] for u in found]
                digests += [xxhash.xxh3_128_digest(u[2].encode("utf-8")) for u in found]
                offsets.append(len(starts))
            raw = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, values) for values in (
                pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(raw[:, 0]), pa.array(raw[:, 1]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), *lists], names=schema.names)

    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")
    ).mapInArrow(run, schema)


def repeated_units(table: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, hi, lo) of the units whose first 64 bits
    of digest occur twice or more, and of few others: the halves alone are
    counted, and only what a fixed-size filter of the repeated ones lets
    through goes on as rows."""
    halves = table.select(F.explode("hi").alias("hi")).groupBy("hi").agg(F.count("*").alias("c")).filter("c > 1")
    halves = materialize(halves.select("hi"), "unit-repeats")
    bits = filter_bits(halves.count())
    words = hash_filter(halves, "hi", bits)
    units = table.select("doc_id", "text_key", F.explode(F.arrays_zip("start", "end", "hi", "lo")).alias("u"))
    return units.filter(may_contain_hash(words, F.col("u.hi"), bits)).select("doc_id", "text_key", "u.start", "u.end", "u.hi", "u.lo")


def removed_units(
    docs: DataFrame, unit: str = "line", min_sentence: int = 8, id_col: str = "doc_id", text_col: str = "text",
    windows: bool = False,
) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_key, n_units,
    n_removed, n_chars_removed and removed (ordered, disjoint spans of the
    original text)."""
    table = materialize(unit_table(docs, unit, min_sentence, id_col, text_col, windows), "units")
    units = repeated_units(table)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start", "text_key", "end")
    firsts = units.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(
        "hi", "lo", "first"
    )
    # A window that overlaps its own earliest occurrence is no repeat of it.
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    repeat = ~place.eqNullSafe(F.col("first")) & ~(own & (F.col("start") < F.col("first.end")))
    later = units.join(firsts, ["hi", "lo"]).filter(repeat).select("doc_id", "text_key", "start", "end")
    # Rows that repeat both id and text give the same spans, and a removed sentence inside a removed line is part of it: in order of
    # start (longest first), spans that end before the reach of the ones
    # before them are left out, and windows begin behind that reach.
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = later.withColumn("reach", F.max("end").over(before)).filter("reach IS NULL OR end > reach").withColumn(
        "start", F.greatest("start", "reach")
    )
    spans = outer.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    counts = table.groupBy("doc_id", "text_key").agg(F.max("n_units").alias("n_units"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    both = counts.join(spans, counts["doc_id"].eqNullSafe(spans["d"]) & (counts["text_key"] == spans["t"]), "left")
    removed = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return both.select(
        "doc_id", "text_key", "n_units", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), removed.alias("removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"])).alias("n_chars_removed"),
    )


def kept_texts(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text, kept_text (what is left, joined in
    place) and removed (spans of the original text, null if there are none)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    spans = removed.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "removed").filter(F.size("removed") > 0)
    both = own.join(spans, own["doc_id"].eqNullSafe(spans["d"]) & (own["text_key"] == spans["t"]), "left")
    text = F.col("text")
    kept = F.aggregate(
        "removed", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["end"].alias("pos"), F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])).alias("out")
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.char_length(text))),
    )
    return both.select("doc_id", "text", F.when(F.col("removed").isNull(), text).otherwise(kept).alias("kept_text"), "removed")
