"""Stored tables and their write rules.

Tables are Parquet; there is no row-level MERGE, so every keyed write is a
set operation: the newest batch row per key (a partial aggregate), joined
to the old table on its key.  These are the set forms, for a whole table at
hand; ``sources.keyed`` stores a table in buckets and rewrites only those that a
batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import netloc_sql

# A scheme as the stdlib URL parser accepts it, followed by ':'.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def accept_targets(submissions: DataFrame, created_at: str = "2024-01-01 00:00:00") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A submitted URL becomes a queued run with a queued discovery item
    when it has a scheme and a network location; everything else goes to
    ``rejects``.

    ``submissions``: (submission_id, url); every submission is a run of its
    own, also of a URL submitted before.  Returns (runs, work items, rejects).
    """
    has_scheme = F.col("url").rlike(_SCHEME)
    net = F.expr(netloc_sql("url"))
    ok = has_scheme & (net != "")
    s = submissions.select("submission_id", "url", ok.alias("ok"), net.alias("netloc"), has_scheme.alias("has_scheme"))
    at = F.to_timestamp(F.lit(created_at))
    runs = s.filter("ok").select(
        F.substring(F.sha2(F.concat_ws("|", "submission_id", "url"), 256), 1, 16).alias("run_id"),
        F.col("url").alias("target_url"),
        F.col("netloc").alias("hostname"),
        F.lit("queued").alias("status"),
        at.alias("created_at"),
        "submission_id",
    )
    items = runs.select(
        F.concat(F.lit("wi-"), "run_id").alias("id"),
        "run_id",
        F.lit("discovery").alias("stage"),
        F.lit("queued").alias("state"),
        F.col("target_url").alias("url"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(100).alias("priority"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )
    rejects = s.filter(~F.col("ok")).select(
        "submission_id",
        "url",
        F.lit("url").alias("field"),
        F.when(~F.col("has_scheme"), F.lit("missing scheme")).otherwise(F.lit("missing host")).alias("reason"),
    )
    return runs, items, rejects


def latest_by_key(rows: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """Latest row per key (the read side of an upsert log).

    A ``max_by`` aggregate rather than a ranked window: versions of a hot
    key are combined map-side before the shuffle.  Ties on ``order_col``
    are broken by the rest of the row, so the result is deterministic.
    """
    others = [c for c in rows.columns if c not in key]
    atomic = ("string", "integer", "long", "short", "byte", "double", "float", "boolean", "timestamp", "timestamp_ntz", "date")
    ties = [f.name for f in rows.schema.fields if f.name in others and f.name != order_col and f.dataType.typeName() in atomic]
    order = F.struct(F.col(order_col), *[F.col(c) for c in ties])
    agg = rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return agg.select(*key, *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)


def upsert(
    existing: DataFrame, batch: DataFrame, key: list[str], order: str | None = None, mutable: list[str] | None = None
) -> DataFrame:
    """``batch`` rows update the ``existing`` row of their key
    field by field, or are inserted.

    Of several batch rows with one key the largest by ``order`` counts (a
    batch without ``order`` must hold a key once).  An update sets the
    ``mutable`` columns the batch has (default: all of them); other columns
    keep their stored value.  Columns of ``batch`` unknown to ``existing``
    (such as ``order``) are not stored.
    """
    new = latest_by_key(batch, key, order) if order else batch
    columns = existing.columns
    settable = [c for c in (mutable or columns) if c in new.columns and c not in key]
    inserted = [c for c in columns if c in new.columns and c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in inserted], F.lit(True).alias("_new"))
    o = existing.withColumn("_old", F.lit(True))
    j = o.join(n, key, "full_outer")

    def value(c: str):
        if c in key or c not in inserted:
            return F.col(c)
        if c in settable:
            return F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)

    return j.select(*[value(c) for c in columns])


def insert_ignore(existing: DataFrame, batch: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add batch rows whose key is new; returns (table, inserted)."""
    inserted = batch.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(inserted), inserted


def changed_transitions(item_log: DataFrame, order_cols: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """Transition rows from an item-state log, one per real change
    (``lag(state)`` within the item).  ``order_cols`` give the save order;
    pass a save sequence when timestamps can tie or run backwards."""
    w = Window.partitionBy("id").orderBy(*order_cols)
    prev = F.lag("state").over(w)
    return (
        item_log.select("id", "state", "updated_at", *[c for c in order_cols if c != "updated_at"], prev.alias("from_state"))
        .filter(F.col("from_state").isNull() | (F.col("from_state") != F.col("state")))
        .select(F.col("id").alias("work_item_id"), "from_state", F.col("state").alias("to_state"), F.col("updated_at").alias("created_at"))
    )


def write_table(df: DataFrame, path: str, cluster_by: str | None = None) -> None:
    """Overwrite a Parquet table (idempotent: a retried job rewrites it).

    With ``cluster_by`` the rows are range-partitioned and sorted by that
    column: readers of one run skip files and row groups by their statistics,
    and millions of runs make no more files than there are partitions.
    """
    if cluster_by:
        df = df.repartitionByRange(cluster_by).sortWithinPartitions(cluster_by)
    df.write.mode("overwrite").parquet(path)
