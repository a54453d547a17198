"""Connected components of an edge table by alternating star contraction.

Every round re-points all neighbours of a vertex to the smallest vertex next
to it (large star on the larger neighbours, small star on the smaller ones).
The table shrinks to one star per component within a number of rounds that
grows with the logarithm of the longest chain.  Each round is joins and
partial aggregates, written to the shared folder, so no component is ever
held in one task and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialize


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for every vertex that has an edge; root is the smallest
    vertex of the component (roots are listed with themselves).

    Null ends and loops are ignored; repeated edges count once.
    """
    e = (
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = materialize(e, f"{name}-edges")
    seen = _checksum(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        e = materialize(small, f"{name}-round")
        now = _checksum(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
