"""Spans of regular-expression matches as array expressions (code points,
end exclusive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
_CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


def running_sums(steps: Column) -> Column:
    """Inclusive prefix sums of an int array, in two levels so the work stays
    near-linear for texts with very many matches."""
    size = F.lit(_CHUNK)

    def with_steps(s):
        chunks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / size).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(s, c * size + 1, size)))

        def with_sums(t):
            offsets = F.transform(t, lambda _, i: total(F.slice(t, F.lit(1), i)))
            return let(offsets, lambda o: F.transform(
                s, lambda _, i: F.get(o, F.floor(i / size).cast("int"))
                + total(F.slice(s, i - i % size + 1, i % size + 1))
            ))

        return let(sums, with_sums)

    return F.when(F.size(steps) > 0, let(steps, with_steps)).otherwise(F.array().cast("array<int>"))


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, end,
    value), ``value`` being a group that takes part in every match.  The
    pattern must not match the empty string."""
    regex = F.lit(pattern)

    def with_matches(m):
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(gaps, m, lambda gap, hit: F.char_length(gap) + F.char_length(hit))
        ends = running_sums(F.slice(steps, F.lit(1), F.size(m)))
        values = m if group == 0 else F.regexp_extract_all(text, regex, F.lit(group))
        return let(ends, lambda e: F.zip_with(
            F.zip_with(e, m, lambda end, hit: F.struct((end - F.char_length(hit)).alias("start"), end.alias("end"))),
            values, lambda se, v: F.struct(se["start"].alias("start"), se["end"].alias("end"), v.alias("value")),
        ))

    spans = let(F.regexp_extract_all(text, regex, F.lit(0)), with_matches)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (o["end"] > span["start"]))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span (ordered by start; overlaps are merged)
    replaced by ``mask``."""
    def step(acc, s):
        fresh = F.struct(
            s["end"].alias("pos"),
            F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask)).alias("out"),
        )
        longer = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["pos"], fresh).otherwise(longer)

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    changed = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, changed).otherwise(text)
