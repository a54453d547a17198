"""Canonical pages and site scores.

Both are one aggregation keyed by (run_id, canonical URL) or run_id; the
winner of a canonical cluster is picked with ``max_by`` so the partial
aggregate combines map-side before the shuffle, even for a hot site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.config import SCORE_DIGITS, SCORE_WEIGHTS
from sitelens.functions.urls import canonical_url

PAGE_COLS = ["title", "description", "provenance", "confidence"]


def _conf_sum():
    return F.coalesce(F.col("confidence.title"), F.lit(0.0)) + F.coalesce(
        F.col("confidence.description"), F.lit(0.0)
    )


def canonicalize(pages: DataFrame) -> DataFrame:
    """One page per (run_id, canonical URL).

    The highest title+description confidence wins; on a tie the first page
    (lowest ``ord``) stays.  The cluster keeps the position of its first
    member, and its URL becomes the canonical form.
    """
    p = pages.withColumn("canonical", canonical_url("url")).withColumn("conf_sum", _conf_sum())
    agg = p.groupBy("run_id", "canonical").agg(
        F.min_by(F.struct(*PAGE_COLS), F.struct(-F.col("conf_sum"), F.col("ord"))).alias("w"),
        F.min("ord").alias("ord"),
    )
    return agg.select("run_id", F.col("canonical").alias("url"), *[F.col("w")[c].alias(c) for c in PAGE_COLS], "ord")


def write_back(stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """The stored pages after a run's canonical pages have replaced what
    the run had stored; pages of other runs stay."""
    others = stored.join(canonical.select("run_id").distinct(), "run_id", "left_anti")
    return others.unionByName(canonical.select(*stored.columns))


def url_clusters(pages: DataFrame) -> DataFrame:
    """Raw URL -> canonical URL, cluster id and cluster size."""
    p = pages.select("run_id", "url", canonical_url("url").alias("canonical_url"))
    sizes = p.groupBy("run_id", "canonical_url").agg(F.count(F.lit(1)).alias("cluster_size"))
    return p.join(sizes, ["run_id", "canonical_url"]).select(
        "run_id",
        "url",
        "canonical_url",
        F.substring(F.sha2(F.concat_ws("|", "run_id", "canonical_url"), 256), 1, 16).alias("cluster_id"),
        "cluster_size",
    )


def dedup_summary(pages: DataFrame) -> DataFrame:
    """Per run raw pages, canonical pages, dedup ratio and the number
    of clusters holding more than one raw URL."""
    c = url_clusters(pages).groupBy("run_id", "canonical_url").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("run_id").agg(
        F.sum("n").cast("long").alias("raw_pages"),
        F.count(F.lit(1)).cast("long").alias("canonical_pages"),
        F.round(1 - F.count(F.lit(1)) / F.sum("n"), 4).alias("dedup_ratio"),
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("conflicts"),
    )


def score_pages(pages: DataFrame, sites: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """Coverage, confidence, redundancy and total per run.

    coverage = mean of the titled and described shares (empty text counts
    as missing); confidence = mean over pages of the mean of the two
    confidences; redundancy = distinct ``url_col`` / pages; total weights
    the unrounded parts.  Runs without pages (from ``sites``) score 0.0.
    """
    n = F.count(F.lit(1))
    titled = F.sum(F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, 1).otherwise(0))
    described = F.sum(F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, 1).otherwise(0))
    agg = pages.groupBy("run_id").agg(
        ((titled / n + described / n) / 2).alias("coverage"),
        F.avg(_conf_sum() / 2).alias("confidence"),
        (F.countDistinct(url_col) / n).alias("redundancy"),
        n.alias("pages"),
    )
    w = SCORE_WEIGHTS
    total = F.col("coverage") * w["coverage"] + F.col("confidence") * w["confidence"] + F.col("redundancy") * w["redundancy"]
    scored = agg.select(
        "run_id",
        F.round("coverage", SCORE_DIGITS).alias("coverage"),
        F.round("confidence", SCORE_DIGITS).alias("confidence"),
        F.round("redundancy", SCORE_DIGITS).alias("redundancy"),
        F.round(total, SCORE_DIGITS).alias("total"),
        F.col("pages").cast("long").alias("pages"),
    )
    if sites is None:
        return scored
    zero = F.lit(0.0)
    return (
        sites.select("run_id")
        .join(scored, "run_id", "left")
        .select(
            "run_id",
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("coverage", "confidence", "redundancy", "total")],
            F.coalesce(F.col("pages"), F.lit(0).cast("long")).alias("pages"),
        )
    )


def completeness(pages: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Title / description completeness per scored run and a review flag
    for low totals; a run without pages has completeness 0 and needs review."""
    agg = pages.groupBy("run_id").agg(
        F.round(F.avg(F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, 1.0).otherwise(0.0)), 4).alias("title_completeness"),
        F.round(F.avg(F.when(F.coalesce(F.length("description"), F.lit(0)) > 0, 1.0).otherwise(0.0)), 4).alias("description_completeness"),
    )
    zero = F.lit(0.0)
    return scores.select("run_id", "total").join(agg, "run_id", "left").select(
        "run_id",
        F.coalesce("title_completeness", zero).alias("title_completeness"),
        F.coalesce("description_completeness", zero).alias("description_completeness"),
        "total",
        (F.col("title_completeness").isNull() | (F.col("total") < threshold)).alias("needs_review"),
    )
