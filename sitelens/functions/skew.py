"""Joins on keys of which a few hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import materialize

#: A key with more than this share of the rows is dealt to several tasks.
HOT_SHARE = 1000
MIN_HOT = 256


def skew_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``side`` (one row per key at most) on ``key``.

    A key that holds more than a thousandth of ``rows`` (fewer than 1,000 keys,
    so their table is broadcast) is split over salts of about that size, and
    its ``side`` row is repeated per salt (2,000 extra rows in all at most).
    ``counts`` (key, count), if known, saves counting.  ``rows`` should be a
    stored table: it is read for the counts and for the join.
    """
    c = counts.toDF(key, "n_rows") if counts is not None else rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    c = c.filter(F.col(key).isNotNull())
    if counts is None:
        c = materialize(c.filter(f"n_rows > {MIN_HOT}"), "join-counts")
        total = rows.count()
    else:
        total = c.agg(F.sum("n_rows")).first()[0] or 0
    share = max(MIN_HOT, -(-total // HOT_SHARE))
    hot = c.filter(F.col("n_rows") > share).withColumn("salts", F.ceil(F.col("n_rows") / share).cast("int")).select(key, "salts")
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(side, key, how)
    salts = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")), F.lit(0)).cast("int")
    left = rows.join(salts, key, "left").withColumn("salt", salt).drop("salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    right = side.join(salts, key, "left").withColumn("salt", copies).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")
