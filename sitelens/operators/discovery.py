"""Tiered URL discovery for all sites at once.

Tier 1 (``llms.txt``) and tier 2 (robots hints) always run; tier 3
(``/sitemap.xml``) runs only for sites where tiers 1-2 found nothing, and
the link-graph scan (tier 4) only where tier 3 found nothing too.  Gating
restricts the *inputs* of the later tiers with anti joins, so their work
is skipped for the other sites, not computed and thrown away.

Every candidate carries ``ord = struct(tier, key)`` where ``key`` is an
array of positions (line number, sitemap path, scan importance); sorting
by it reproduces the order in which a sequential crawler would list the
URLs, and the first source per URL wins by that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import LLMS_LINK, SITEMAP_NS, SpiderBounds
from sitelens.functions.text import py_strip, split_lines
from sitelens.functions.urls import netloc_sql, normalize_http_url, resolve_url, url_raw_path, url_scheme, valid_http_url
from sitelens.operators import linkgraph
from sitelens.operators.extract import capture_index, page_signals, url_key
from sitelens.session import materialize, spread

SITEMAP_SCHEMA = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"


def site_bases(sites: DataFrame) -> DataFrame:
    """run_id, hostname, base (scheme://host of the target), seed_url."""
    return sites.select(
        "run_id",
        "hostname",
        F.concat(url_scheme("target_url"), F.lit("://"), F.col("hostname")).alias("base"),
        F.col("target_url").alias("seed_url"),
    )


def fetch_bodies(cands: DataFrame, captures: DataFrame, index: DataFrame, url_col: str = "fetch_url") -> DataFrame:
    """S2 with the body: latest capture of each candidate URL.

    ``captures`` are the discovery-file captures (``discovery_files``), a
    small table, so bringing bodies to the candidates never shuffles page
    bodies.  The key join runs against the body-free capture index first.
    """
    c = cands.withColumn("url_key", url_key(url_col))
    c = c.join(index.select("url_key", "fetched_at", "status_code"), "url_key", "left")
    bodies = captures.select(url_key("url").alias("url_key"), "fetched_at", "body")
    c = c.join(bodies, ["url_key", "fetched_at"], "left")
    return c.withColumn("status_code", F.coalesce("status_code", F.lit(404)))


def discovery_files(captures: DataFrame) -> DataFrame:
    """The captures that discovery may fetch: llms.txt and robots.txt by
    path, sitemaps by their namespace.  A map-only filter over the captures;
    what is left is small, and page bodies never reach a join."""
    path = url_raw_path("url")
    return captures.filter(path.isin("/llms.txt", "/robots.txt") | F.col("body").contains(SITEMAP_NS))


def _ord(tier: int, key: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), key.cast("array<long>").alias("key"))


# ---------------------------------------------------------------------------
# Llms.txt
# ---------------------------------------------------------------------------
def llms_strategy(bases: DataFrame, captures: DataFrame, index: DataFrame):
    """Candidates (run_id, raw_url, source, ord) and the strategy log."""
    f = fetch_bodies(bases.withColumn("fetch_url", F.concat("base", F.lit("/llms.txt"))), captures, index)
    # One file may hold most lines of all sites.
    lines = spread(f.filter(F.col("status_code") == 200).select(
        "run_id", "base", F.posexplode(split_lines(F.col("body"))).alias("line_no", "line")
    ), "run_id", "line_no")
    hits = lines.filter(F.col("line").rlike(LLMS_LINK)).withColumn("href", F.regexp_extract("line", LLMS_LINK, 1))
    cands = hits.select(
        "run_id",
        resolve_url(F.col("base"), F.col("href")).alias("raw_url"),
        F.lit("llms").alias("source"),
        _ord(1, F.array("line_no")).alias("ord"),
    )
    cands = materialize(cands, "cand-llms")
    log = _strategy_log(f, cands, "direct_llms")
    return cands, log


# ---------------------------------------------------------------------------
# sitemaps
# ---------------------------------------------------------------------------
def parse_sitemap(body: Column) -> Column:
    """D3: struct(children array<string>, urls array<string>) of a sitemap
    body; NULL arrays for anything that is not a sitemaps.org document.

    Namespace prefixes are removed before parsing; the default namespace
    must be the sitemaps.org one.
    """
    plain = F.regexp_replace(body, r"<(/?)[A-Za-z_][\w.\-]*:", "<$1")
    ns_ok = body.contains(SITEMAP_NS)
    x = F.from_xml(plain, SITEMAP_SCHEMA, {"mode": "PERMISSIVE"})
    locs = lambda arr: F.transform(arr, lambda e: e["loc"])
    return F.when(ns_ok, F.struct(locs(x["sitemap"]).alias("children"), locs(x["url"]).alias("urls")))


def _children(parsed: DataFrame, changed: DataFrame) -> DataFrame:
    """(run_id, tier, node, key, fetch_url): the least path to each child over
    the sitemaps whose own path has just changed."""
    e = parsed.join(changed, ["run_id", "tier", "node"]).select("run_id", "tier", "key", F.posexplode("children").alias("pos", "child"))
    paths = e.select(
        "run_id", "tier", url_key("child").alias("node"),
        F.concat("key", F.array(F.lit(0).cast("long"), F.col("pos").cast("long"))).alias("key"), F.col("child").alias("fetch_url"),
    ).filter(F.col("node").isNotNull())
    return _least_path(paths)


def _least_path(paths: DataFrame) -> DataFrame:
    m = paths.groupBy("run_id", "tier", "node").agg(F.min(F.struct("key", "fetch_url")).alias("m"))
    return m.select("run_id", "tier", "node", "m.key", "m.fetch_url")


def expand_sitemaps(
    roots: DataFrame, captures: DataFrame, index: DataFrame
) -> DataFrame:
    """Recursive sitemap-index expansion, to any depth.

    ``roots``: (run_id, tier, key array<long>, sitemap_url).  Output:
    (run_id, loc, ord) with a child sitemap's URLs before the parent's own
    (key + [0, child] < key + [1, url]).

    A semi-naive fixpoint over the sitemap graph: each sitemap of a (run, tier)
    is fetched and parsed once and keeps the least path key that reaches it,
    which is its place in a sequential depth-first walk that visits every
    sitemap once.  A round extends only the paths that became smaller in the
    last one, so trees take one round per level, diamonds and cycles add no
    rows, and the rounds end on any finite set of sitemaps.
    """
    node = ["run_id", "tier", "node"]
    changed = _least_path(roots.select(
        "run_id", "tier", url_key("sitemap_url").alias("node"), "key", F.col("sitemap_url").alias("fetch_url")
    ).filter(F.col("node").isNotNull()))
    changed = materialize(changed, "sitemap-paths")
    paths, parsed = changed, None
    fresh, turn = changed, 0
    # The arrays keep their blanks: positions in a sitemap are part of the path.
    texts = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    while True:
        if parsed is None or not fresh.isEmpty():
            sm = fetch_bodies(fresh, captures, index).filter(F.col("status_code") == 200).select(
                *node, parse_sitemap(F.col("body")).alias("sm")
            )
            new = materialize(sm.select(*node, texts(F.col("sm.children")).alias("children"), texts(F.col("sm.urls")).alias("urls")), "sitemaps")
            parsed = new if parsed is None else parsed.unionByName(new)
        best = paths.groupBy(*node).agg(F.min("key").alias("best"))
        found = _children(parsed, changed.select(*node, "key")).filter("fetch_url <> ''").join(best, node, "left")
        changed = materialize(found.filter("best IS NULL OR key < best"), "sitemap-paths")
        if changed.isEmpty():
            break
        fresh = changed.filter("best IS NULL")
        paths = paths.unionByName(changed.drop("best"))
        turn += 1
        if turn % 4 == 0:  # a short union, however many rounds there are
            paths = materialize(_least_path(paths), "sitemap-best")
    best = paths.groupBy(*node).agg(F.min("key").alias("key"))
    urls = parsed.join(best, node).select("run_id", "tier", "key", F.posexplode("urls").alias("pos", "loc"))
    return spread(urls.filter(F.col("loc") != ""), "run_id", "loc").select(
        "run_id", F.col("loc").alias("raw_url"),
        F.struct("tier", F.concat("key", F.array(F.lit(1).cast("long"), F.col("pos").cast("long"))).alias("key")).alias("ord"),
    )


# ---------------------------------------------------------------------------
# Robots.txt hints
# ---------------------------------------------------------------------------
def robots_strategy(bases: DataFrame, captures: DataFrame, index: DataFrame):
    f = fetch_bodies(bases.withColumn("fetch_url", F.concat("base", F.lit("/robots.txt"))), captures, index)
    lines = f.filter(F.col("status_code") == 200).select(
        "run_id", "base", F.posexplode(split_lines(F.col("body"))).alias("line_no", "line")
    )
    low = F.lower("line")
    value = py_strip(F.expr("substring(line, instr(line, ':') + 1)"))
    hints = lines.filter(low.startswith("llms:")).select(
        "run_id",
        resolve_url(F.col("base"), value).alias("raw_url"),
        F.lit("robots").alias("source"),
        _ord(2, F.array("line_no")).alias("ord"),
    )
    roots = lines.filter(low.startswith("sitemap:")).select(
        "run_id", F.lit(2).alias("tier"), F.array(F.col("line_no").cast("long")).alias("key"), value.alias("sitemap_url")
    )
    maps = expand_sitemaps(roots, captures, index).withColumn("source", F.lit("sitemap"))
    cands = materialize(hints.unionByName(maps.select("run_id", "raw_url", "source", "ord")), "cand-robots")
    log = _strategy_log(f, cands, "robots_hints")
    return cands, log


# ---------------------------------------------------------------------------
# Well-known sitemap
# ---------------------------------------------------------------------------
def sitemap_strategy(bases: DataFrame, captures: DataFrame, index: DataFrame):
    roots = bases.select(
        "run_id", F.lit(3).alias("tier"), F.array().cast("array<long>").alias("key"),
        F.concat("base", F.lit("/sitemap.xml")).alias("sitemap_url"),
    )
    maps = expand_sitemaps(roots, captures, index)
    cands = materialize(maps.select("run_id", "raw_url", F.lit("sitemap").alias("source"), "ord"), "cand-sitemap")
    log = _strategy_log(bases.withColumn("status_code", F.lit(None).cast("int")), cands, "sitemap")
    return cands, log


# ---------------------------------------------------------------------------
# Tier 4: link-graph scan
# ---------------------------------------------------------------------------
def spider_strategy(bases: DataFrame, index: DataFrame, signals: DataFrame, bounds: SpiderBounds):
    seeds = bases.select(F.col("run_id").alias("site"), "hostname", "seed_url")
    scan = linkgraph.bfs_scan(seeds, index, signals, bounds)
    top = linkgraph.top_pages(scan, bounds.max_index_pages)
    cands = top.select(
        F.col("site").alias("run_id"),
        F.col("url_key").alias("raw_url"),
        F.lit("crawl").alias("source"),
        _ord(4, F.array("importance")).alias("ord"),
    )
    cands = materialize(cands, "cand-spider")
    log = _strategy_log(bases.withColumn("status_code", F.lit(None).cast("int")), cands, "spider")
    return cands, log, scan


def _strategy_log(attempts: DataFrame, cands: DataFrame, strategy: str) -> DataFrame:
    """One row per (run, strategy): success and the status code of a
    failed probe."""
    found = cands.filter(valid_http_url("raw_url")).groupBy("run_id").agg(F.count(F.lit(1)).alias("found"))
    a = attempts.select("run_id", "status_code").join(found, "run_id", "left")
    n = F.coalesce(F.col("found"), F.lit(0)).cast("long")
    return a.select(
        "run_id",
        F.lit(strategy).alias("strategy"),
        (n > 0).alias("success"),
        F.when(F.col("status_code") != 200, F.col("status_code")).alias("status_code"),
        n.alias("urls_found"),
    )


# ---------------------------------------------------------------------------
# Gating and first source wins
# ---------------------------------------------------------------------------
@dataclass
class DiscoveryResult:
    discovered: DataFrame  # run_id, url, provenance, ord
    candidates: DataFrame  # run_id, raw_url, source, ord (all tiers, raw)
    rejects: DataFrame  # run_id, url, field, reason
    strategy_log: DataFrame
    scan: linkgraph.ScanResult | None
    signals: DataFrame  # of the pages on scanned hosts


def first_source(cands: DataFrame) -> DataFrame:
    """Per (run, URL) the source listed first wins."""
    v = cands.filter(valid_http_url("raw_url")).withColumn("url", normalize_http_url("raw_url"))
    agg = spread(v, "run_id", "url").groupBy("run_id", "url").agg(F.min(F.struct("ord", "source")).alias("m"))
    return agg.select("run_id", "url", F.col("m.source").alias("provenance"), F.col("m.ord").alias("ord"))


def discover(
    sites: DataFrame,
    captures: DataFrame,
    index: DataFrame,
    bounds: SpiderBounds | None = None,
    files: DataFrame | None = None,
) -> DiscoveryResult:
    """Run the tiers with gating for every site.

    ``files``: the captures of discovery fetches, if they are stored apart;
    otherwise they are picked from ``captures`` once.  Only pages on the
    hosts that reach the link-graph scan are parsed here.
    """
    b = bounds or SpiderBounds()
    bases = site_bases(sites)
    page_index = index
    pages = captures
    captures = files if files is not None else materialize(discovery_files(captures), "discovery-files")
    index = materialize(capture_index(captures), "files-index")
    llms, log1 = llms_strategy(bases, captures, index)
    robots, log2 = robots_strategy(bases, captures, index)
    tier12 = llms.unionByName(robots)
    hit12 = tier12.filter(valid_http_url("raw_url")).select("run_id").distinct()
    bases3 = bases.join(hit12, "run_id", "left_anti")
    smap, log3 = sitemap_strategy(bases3, captures, index)
    hit3 = smap.filter(valid_http_url("raw_url")).select("run_id").distinct()
    bases4 = bases3.join(hit3, "run_id", "left_anti")
    hosts = bases4.select("hostname").distinct()
    keys = page_index.join(hosts, F.expr(netloc_sql("url_key")) == F.col("hostname"), "left_semi")
    signals = materialize(page_signals(pages, keys), "spider-signals")
    spider, log4, scan = spider_strategy(bases4, page_index, signals, b)
    cands = tier12.unionByName(smap).unionByName(spider)
    rejects = cands.filter(~valid_http_url("raw_url") | F.col("raw_url").isNull()).select(
        "run_id", F.col("raw_url").alias("url"), F.lit("url").alias("field"), F.lit("not an http(s) URL").alias("reason")
    )
    logs = materialize(log1.unionByName(log2).unionByName(log3).unionByName(log4), "strategy-log")
    discovered = materialize(first_source(cands), "discovered")
    return DiscoveryResult(discovered, cands, rejects, logs, scan, signals)


def discovery_milestones(discovered: DataFrame, runs: DataFrame) -> DataFrame:
    """URLs discovered and the distinct sources used, for every run."""
    found = discovered.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("pages_discovered"),
        F.array_join(F.array_sort(F.collect_set("provenance")), ",").alias("strategies_used"),
    )
    return runs.select("run_id").join(found, "run_id", "left").select(
        "run_id",
        F.coalesce("pages_discovered", F.lit(0).cast("long")).alias("pages_discovered"),
        F.coalesce("strategies_used", F.lit("")).alias("strategies_used"),
    )
