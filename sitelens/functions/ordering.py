"""Exact per-key row numbers without putting a hot key in one task.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sorts every row
of a key in a single task.  ``keyed_row_number`` gives the same numbers
from a range partitioning instead:

1. range-partition by (key, order): a key that holds a third of the rows
   spans many partitions;
2. number rows inside each (partition, key) chunk;
3. count rows per (key, partition) - a small table - and turn the counts
   into per-chunk offsets with a running sum over the partition ids;
4. number = offset of the chunk + number inside the chunk.

``keyed_prefix_sums`` does the same with sums of columns in place of counts.

The ordering must be total (add a unique column to break ties).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import materialize


def keyed_row_number(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn", num_partitions: int | None = None
) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    local = Window.partitionBy("_pid", *keys).orderBy(*order)
    # Written once so both uses below see the same partition ids.
    part = materialize(ranged.withColumn("_local", F.row_number().over(local)), "ranged")
    counts = part.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    out = part.join(offsets, [*keys, "_pid"]).withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
    return out.drop("_pid", "_local", "_off")


def keyed_prefix_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], num_partitions: int | None = None
) -> DataFrame:
    """``df`` with one column per entry of ``sums``: the sum of the expression
    (a whole number, not null) over the rows of the key that come before."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    before = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{x}") for x, c in sums.items()]
    own = [c.alias(f"_own_{x}") for x, c in sums.items()]
    # Written once so both uses below see the same partition ids.
    part = materialize(ranged.select("*", *local, *own), "ranged-sums")
    chunks = part.groupBy(*keys, "_pid").agg(*[F.sum(f"_own_{x}").alias(f"_sum_{x}") for x in sums])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*keys, "_pid", *[F.coalesce(F.sum(f"_sum_{x}").over(earlier), F.lit(0)).alias(f"_off_{x}") for x in sums])
    out = part.join(offsets, [*keys, "_pid"])
    return out.select(*df.columns, *[(F.col(f"_off_{x}") + F.col(f"_before_{x}")).cast("long").alias(x) for x in sums])
