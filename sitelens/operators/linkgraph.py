"""Link graph and bounded breadth-first scan.

The scan of every site runs at once, one round per depth level (at most
``max_depth`` rounds, each a handful of joins on small rows):

  links(site, src, dst, pos)  -> G1 over the pages of the sites' hosts, once
  frontier(site, url_key, depth, rank)
    JOIN expanding pages      -> which frontier pages expand (200 + text)
    JOIN links                -> their targets
    ANTI JOIN seen            -> new URLs
    min(struct(src_rank,pos)) -> first discoverer of each new URL
    row_number within site + offset -> BFS rank; ranks >= budget dropped

The BFS rank reproduces FIFO order exactly: a level is visited in rank
order and a new URL is enqueued by the first visited page (lowest rank)
that links to it, in that page's link order.  Each round's frontier is
written once to the session's reliable checkpoint folder (``materialize``):
lineage stays short, ``seen`` is a union of those files, and a lost executor
recomputes one round at most.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.config import SpiderBounds
from sitelens.functions.urls import (
    netloc_sql,
    non_content_sql,
    normalize_http_url,
    normalize_sql,
    path_sql,
    strip_fragment_sql,
    suffix_sql,
)
from sitelens.session import ensure_checkpoint_dir, materialize, spread


def filtered_links(expanding: DataFrame, signals: DataFrame, extensions) -> DataFrame:
    """G1: same-domain, fragment-free, allowed-extension, content links of
    each expanding page, deduplicated per page in document order.

    ``expanding``: (site, hostname, url_key, ...); ``signals``: url_key,
    links (resolved hrefs).  Returns (site, src, dst, pos) + the carried
    columns of ``expanding``.
    """
    # Links take much more room than their files: shuffled, never broadcast.
    j = spread(expanding, "url_key").join(signals.select("url_key", "links").hint("shuffle_merge"), "url_key")
    ex = j.select("*", F.posexplode("links").alias("pos", "link")).drop("links")
    nf = strip_fragment_sql("link")
    path = path_sql("link")
    keep = F.expr(
        f"({netloc_sql('link')} = '' OR {netloc_sql('link')} = hostname) AND {nf} <> '' "
        f"AND {suffix_sql(path)} IN ({', '.join(repr(e) for e in sorted(set(extensions)))}) "
        f"AND NOT {non_content_sql(path)}"
    )
    ex = ex.filter(keep).withColumn("dst", F.expr(normalize_sql(nf))).filter(F.col("dst").isNotNull())
    carried = [c for c in expanding.columns if c not in ("url_key",)]
    return (
        ex.groupBy(*carried, F.col("url_key").alias("src"), "dst")
        .agg(F.min("pos").alias("pos"))
    )


@dataclass
class ScanResult:
    visited: DataFrame  # site, url_key, depth, rank, expanded
    edges: DataFrame  # site, src, src_rank, dst, pos  (from expanded pages)
    seconds: float = 0.0  # wall time of the scan (all sites together)


def bfs_scan(
    seeds: DataFrame,
    index: DataFrame,
    signals: DataFrame,
    bounds: SpiderBounds | None = None,
) -> ScanResult:
    """Bounded BFS from each site's seed.

    ``seeds``: (site, hostname, seed_url).  ``index``: capture index
    (url_key, status_code, content_type).  ``signals``: url_key, links.
    """
    b = bounds or SpiderBounds()
    began = time.monotonic()
    ensure_checkpoint_dir(seeds.sparkSession)
    ctype = F.coalesce(F.col("content_type"), F.lit(""))
    expands = (F.col("status_code") == 200) & (ctype.contains("text/html") | ctype.contains("text/plain"))
    status = index.select("url_key", expands.alias("expanded")).filter("expanded")

    seen = seeds.select(
        "site",
        normalize_http_url("seed_url").alias("url_key"),
        F.lit(0).alias("depth"),
        F.lit(0).cast("long").alias("rank"),
    ).filter(F.col("url_key").isNotNull())
    # G1 runs once over the pages on the sites' hosts: a scan never leaves
    # its host, so the rounds only join their frontier to these links.
    hosts = seeds.select("site", "hostname", F.expr(netloc_sql(normalize_sql("seed_url"))).alias("host_key"))
    pages = signals.select("url_key", F.expr(netloc_sql("url_key")).alias("host_key")).join(hosts, "host_key").join(
        status.hint("shuffle_merge"), "url_key", "left_semi"
    )
    links = materialize(filtered_links(pages.select("site", "hostname", "url_key"), signals, b.extension_set).drop("hostname"), "bfs-links").hint("shuffle_merge")
    # A row per page, as the links: shuffled to the few visited URLs, never broadcast.
    known = materialize(status, "bfs-expands").hint("shuffle_merge")

    frontier = seen
    for depth in range(b.max_depth):
        src = frontier.join(known, "url_key", "left_semi").select("site", F.col("url_key").alias("src"), F.col("rank").alias("src_rank"))
        new = links.join(src, ["site", "src"]).join(
            seen.select("site", F.col("url_key").alias("dst")), ["site", "dst"], "left_anti"
        )
        first = new.groupBy("site", "dst").agg(F.min(F.struct("src_rank", "pos")).alias("k"))
        offset = seen.groupBy("site").agg((F.max("rank") + 1).alias("offset"))
        # The plain limit on the row number runs before the shuffle (a task
        # hands on at most the page budget per site), the offset comes after.
        w = Window.partitionBy("site").orderBy("k", "dst")
        nearest = first.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= b.max_scan_pages)
        ranked = (
            nearest.join(offset, "site")
            .withColumn("rank", F.col("offset") + F.col("nth") - 1)
            .filter(F.col("rank") < b.max_scan_pages)
            .select("site", F.col("dst").alias("url_key"), F.lit(depth + 1).alias("depth"), "rank")
        )
        frontier = materialize(ranked, "bfs-frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    visited = seen.join(known, "url_key", "left").select(
        "site", "url_key", "depth", "rank", F.coalesce("expanded", F.lit(False)).alias("expanded")
    )
    sources = visited.filter("expanded").select("site", F.col("url_key").alias("src"), F.col("rank").alias("src_rank"))
    edges = links.join(sources, ["site", "src"]).select("site", "src", "src_rank", "dst", "pos")
    visited, edges = materialize(visited, "bfs-visited"), materialize(edges, "bfs-edges")
    return ScanResult(visited=visited, edges=edges, seconds=time.monotonic() - began)


def inlink_counts(scan: ScanResult) -> DataFrame:
    """In-links of each visited URL from expanded pages (self-links
    and links to already visited pages count)."""
    counts = scan.edges.groupBy("site", F.col("dst").alias("url_key")).agg(F.count(F.lit(1)).alias("inlinks"))
    return scan.visited.join(counts, ["site", "url_key"], "left").select(
        "site", "url_key", "depth", "rank", F.coalesce("inlinks", F.lit(0)).cast("long").alias("inlinks")
    )


def rank_pages(scan: ScanResult) -> DataFrame:
    """Visited URLs by in-links desc, depth asc, URL asc."""
    w = Window.partitionBy("site").orderBy(F.col("inlinks").desc(), "depth", "url_key")
    return inlink_counts(scan).withColumn("importance", F.row_number().over(w))


def top_pages(scan: ScanResult, n: int) -> DataFrame:
    """The ``n`` most important visited URLs per site."""
    return rank_pages(scan).filter(F.col("importance") <= n)


def page_scan_audit(scan: ScanResult) -> DataFrame:
    """Per expanded page: depth, links found and its in-link score at
    scan time (edges from pages visited before it)."""
    links_found = scan.edges.groupBy("site", F.col("src").alias("url_key")).agg(
        F.count(F.lit(1)).alias("links_found")
    )
    exp = scan.visited.filter("expanded").select("site", "url_key", "depth", "rank")
    earlier = (
        scan.edges.select("site", "src_rank", F.col("dst").alias("url_key"))
        .join(exp.select("site", "url_key", "rank"), ["site", "url_key"])
        .filter(F.col("src_rank") < F.col("rank"))
        .groupBy("site", "url_key")
        .agg(F.count(F.lit(1)).alias("inlink_score"))
    )
    return (
        exp.join(links_found, ["site", "url_key"], "left")
        .join(earlier, ["site", "url_key"], "left")
        .select(
            "site",
            "url_key",
            "depth",
            "rank",
            F.coalesce("links_found", F.lit(0)).cast("long").alias("links_found"),
            F.coalesce("inlink_score", F.lit(0)).cast("long").alias("inlink_score"),
        )
    )


def scan_summary(scan: ScanResult, bounds: SpiderBounds | None = None) -> DataFrame:
    """Pages scanned and unique link targets per site, with bounds and
    the duration of the scan its sites shared."""
    b = bounds or SpiderBounds()
    pages = scan.visited.groupBy("site").agg(F.count(F.lit(1)).cast("long").alias("pages_scanned"))
    uniq = scan.edges.groupBy("site").agg(F.countDistinct("dst").cast("long").alias("unique_links_found"))
    return pages.join(uniq, "site", "left").select(
        "site",
        "pages_scanned",
        F.coalesce("unique_links_found", F.lit(0)).cast("long").alias("unique_links_found"),
        F.lit(b.max_depth).alias("max_depth"),
        F.lit(b.max_scan_pages).alias("max_scan_pages"),
        F.lit(round(scan.seconds, 3)).alias("duration_seconds"),
    )
