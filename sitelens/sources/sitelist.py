"""S3: categorised site lists.

The list is JSON with ``categories: map<category, {name, description,
sites: [{id, url, notes}]}>``; a file may hold one such object per line.
Reading explodes the map and the site arrays; a category filter selects
sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_LIST_SCHEMA = (
    "categories map<string, struct<name:string, description:string, "
    "sites:array<struct<id:string, url:string, notes:string>>>>"
)


def read_site_list(spark: SparkSession, path: str, categories: list[str] | None = None) -> DataFrame:
    raw = spark.read.schema(SITE_LIST_SCHEMA).json(path)
    cats = raw.select(F.explode("categories").alias("category", "c"))
    sites = cats.select("category", F.col("c.name").alias("category_name"), F.explode("c.sites").alias("s"))
    out = sites.select("category", "category_name", F.col("s.id").alias("site_id"), F.col("s.url").alias("url"), F.col("s.notes").alias("notes"))
    if categories:
        out = out.filter(F.col("category").isin(categories))
    return out


def write_site_list(sites: DataFrame, path: str) -> None:
    """Write (category, category_name, description, site_id, url, notes)
    rows as site-list JSON lines (one single-site category object each)."""
    doc = sites.select(
        F.create_map(
            F.col("category"),
            F.struct(
                F.col("category_name").alias("name"),
                F.col("description"),
                F.array(F.struct(F.col("site_id").alias("id"), F.col("url"), F.col("notes"))).alias("sites"),
            ),
        ).alias("categories")
    )
    doc.write.mode("overwrite").json(path)
