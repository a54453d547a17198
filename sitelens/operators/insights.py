"""Capabilities the design documents describe beyond the pipeline
(X1-X14): URL clusters, skipped-link audit, robots rules, strategy
statistics, completeness flags, conditional-request savings, hierarchical
sections, markdown pages, document diffs, recency and staleness,
freshness-weighted importance and a politeness plan.

All are joins, windows and aggregations keyed by run / site; nothing is
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.config import RECENT_WINDOW_HOURS
from sitelens.functions.text import py_strip, split_lines
from sitelens.functions.urls import netloc_sql, non_content_sql, part_sql, path_sql, raw_path_sql, strip_fragment_sql, suffix_sql
from sitelens.operators.audit import duration_seconds

# ---------------------------------------------------------------------------
# Skipped-link audit
# ---------------------------------------------------------------------------
def link_audit(links: DataFrame, extensions) -> DataFrame:
    """Every link of every page with the reason it is not followed
    (NULL = followed): external, empty, duplicate, extension_filtered,
    non_content_path.  ``links``: (page_url, hostname, pos, link)."""
    exts = ", ".join(repr(e) for e in sorted(set(extensions)))
    nf, path, net = strip_fragment_sql("link"), path_sql("link"), netloc_sql("link")
    reason = F.expr(
        f"CASE WHEN {net} <> '' AND {net} <> hostname THEN 'external' "
        f"WHEN {nf} = '' THEN 'empty' "
        f"WHEN {suffix_sql(path)} NOT IN ({exts}) THEN 'extension_filtered' "
        f"WHEN {non_content_sql(path)} THEN 'non_content_path' END"
    )
    a = links.withColumn("reason", reason).withColumn("link_no_fragment", F.expr(nf))
    w = Window.partitionBy("page_url", "link_no_fragment", F.col("reason").isNull()).orderBy("pos")
    first = F.row_number().over(w) == 1
    return a.withColumn("reason", F.when(F.col("reason").isNull() & ~first, F.lit("duplicate")).otherwise(F.col("reason"))).select(
        "page_url", "pos", "link", "reason"
    )


def scan_skips(visited: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Links found by a bounded scan whose target it never visited:
    ``depth_exceeded`` from pages at the last depth, else ``page_budget``."""
    src = visited.select("site", F.col("url_key").alias("src"), F.col("depth").alias("src_depth"))
    seen = visited.select("site", F.col("url_key").alias("dst"))
    out = edges.select("site", "src", "dst").join(seen, ["site", "dst"], "left_anti").join(src, ["site", "src"])
    reason = F.when(F.col("src_depth") >= max_depth, "depth_exceeded").otherwise("page_budget")
    return out.select("site", "src", "dst", reason.alias("reason"))


# ---------------------------------------------------------------------------
# Robots.txt rules
# ---------------------------------------------------------------------------
def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Allow / Disallow rules of the ``agent`` group of each robots.txt.

    ``robots``: (run_id, body).  Consecutive ``User-agent`` lines share the
    rules below them, and a group may occur several times.  Returns (run_id,
    kind, prefix, pattern): a rule with ``*`` or a final ``$`` has the regular
    expression ``pattern`` and as ``prefix`` the text before its first wildcard.
    """
    lines = robots.select("run_id", F.posexplode(split_lines(F.col("body"))).alias("line_no", "raw"))
    line = py_strip(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.withColumn("line", line).filter(F.col("line") != "")
    low = F.lower("line")
    value = py_strip(F.expr("substring(line, instr(line, ':') + 1)"))
    tagged = lines.select(
        "run_id", "line_no",
        F.when(low.startswith("user-agent:"), F.lower(value)).alias("agent"),
        F.when(low.startswith("disallow:"), F.lit("disallow")).when(low.startswith("allow:"), F.lit("allow")).alias("kind"),
        value.alias("value"),
    ).filter(F.col("agent").isNotNull() | F.col("kind").isNotNull())
    # A group starts at a User-agent line that does not follow another one;
    # files are small, so one run's lines are ordered together.
    w = Window.partitionBy("run_id").orderBy("line_no")
    starts = F.col("agent").isNotNull() & F.coalesce(F.lag("kind").over(w).isNotNull(), F.lit(True))
    tagged = tagged.withColumn("starts", starts.cast("int"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    grouped = tagged.withColumn("grp", F.sum("starts").over(upto))
    mine = grouped.filter(F.col("agent") == agent.lower()).select("run_id", "grp").distinct()
    rules = grouped.filter(F.col("kind").isNotNull() & (F.col("value") != "")).join(mine, ["run_id", "grp"], "left_semi")
    wild = F.col("value").rlike(r"[*]|[$]$")
    body = F.regexp_replace("value", r"[$]$", "")
    pieces = F.transform(F.split(body, r"[*]", -1), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    pattern = F.concat(F.lit("^"), F.array_join(pieces, ".*"), F.when(F.col("value").endswith("$"), F.lit("$")).otherwise(F.lit("")))
    return rules.select(
        "run_id", "kind", F.when(wild, F.regexp_extract("value", r"^([^*$]*)", 1)).otherwise(F.col("value")).alias("prefix"),
        F.when(wild, pattern).alias("pattern"), F.length("value").alias("rule_length"),
    ).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Longest matching rule decides (Allow wins a tie); no rule = allowed.
    Rules are matched against the path with its parameters and query.

    Each URL is cut to the prefix lengths that occur among the rules of its
    run and meets the rules with an equi-join on (run_id, prefix); wildcard
    rules are then checked on the rows that share their literal prefix.
    """
    target = F.expr(f"concat(CASE WHEN {raw_path_sql('url')} = '' THEN '/' ELSE {raw_path_sql('url')} END, {part_sql('url', 6)})")
    u = urls.withColumn("target", target)
    lengths = rules.groupBy("run_id").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = u.join(lengths, "run_id").select(
        "run_id", "url", "target",
        F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("target")), lambda n: F.substring(F.col("target"), F.lit(1), n))).alias("prefix"),
    )
    m = cut.join(rules, ["run_id", "prefix"]).filter(F.col("pattern").isNull() | F.expr("target RLIKE pattern"))
    best = m.groupBy("run_id", "url").agg(
        F.max_by("kind", F.struct(F.col("rule_length"), (F.col("kind") == "allow"))).alias("kind")
    )
    return u.join(best, ["run_id", "url"], "left").select(
        "run_id", "url", F.coalesce(F.col("kind") != "disallow", F.lit(True)).alias("allowed")
    )


# ---------------------------------------------------------------------------
# Strategy statistics
# ---------------------------------------------------------------------------
def strategy_rates(log: DataFrame) -> DataFrame:
    """Attempts, successes and success rate per strategy."""
    return log.groupBy("strategy").agg(
        F.count(F.lit(1)).cast("long").alias("attempts"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("long").alias("successes"),
        F.round(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), 4).alias("success_rate"),
    )


_STRATEGY_ORDER = ("direct_llms", "robots_hints", "sitemap", "spider")


def fallback_depth(log: DataFrame) -> DataFrame:
    """Per run the strategies tried and the place of the first one that
    succeeded in the fixed order (NULL when none did)."""
    place = F.array_position(F.array(*[F.lit(s) for s in _STRATEGY_ORDER]), F.col("strategy"))
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.min(F.when(F.col("success"), place)).cast("long").alias("fallback_depth")
    )


#: Size of a latency sketch and the rank error stated for it (a sketch of a
#: sketch keeps it: merging loses nothing more).
LATENCY_K, LATENCY_RANK_ERROR = 800, 0.01
LATENCY_RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_sketches(attempts: DataFrame) -> DataFrame:
    """Per run and strategy the attempts, their fastest and slowest
    latency and a quantile sketch (KLL) of a few KB, to be stored and merged.

    ``attempts``: (run_id, strategy, latency_ms); rows without latency do not
    count.  The sketch is a partial aggregate: tasks send sketches, not rows.
    """
    return attempts.filter(F.col("latency_ms").isNotNull()).groupBy("run_id", "strategy").agg(
        F.count(F.lit(1)).cast("long").alias("attempts"), F.min("latency_ms").alias("fastest_ms"), F.max("latency_ms").alias("slowest_ms"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), LATENCY_K).alias("sketch"),
    )


def latency_percentiles(sketches: DataFrame, keys: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Latency percentiles per strategy from the stored sketches of any
    runs; each lies within ``LATENCY_RANK_ERROR`` of its rank."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("attempts").alias("attempts"), F.min("fastest_ms").alias("fastest_ms"), F.max("slowest_ms").alias("slowest_ms"),
        F.kll_merge_agg_double("sketch", LATENCY_K).alias("sketch"),
    )
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"{name}_ms") for name, p in LATENCY_RANKS.items()]
    return merged.select(*keys, "attempts", "fastest_ms", "slowest_ms", *at)


def latency_rank_errors(attempts: DataFrame, percentiles: DataFrame) -> DataFrame:
    """How far the rank of each percentile in all ``attempts`` is from the
    wanted one (0 where equal values reach over it); one row per strategy."""
    sides = []
    for name in LATENCY_RANKS:
        sides += [F.avg((F.col("latency_ms") < F.col(f"{name}_ms")).cast("double")).alias(f"{name}_below"),
                  F.avg((F.col("latency_ms") <= F.col(f"{name}_ms")).cast("double")).alias(f"{name}_upto")]
    # A row per strategy: few, and AQE measures them before a broadcast.
    ranks = attempts.filter(F.col("latency_ms").isNotNull()).join(percentiles, "strategy").groupBy("strategy").agg(*sides)
    return ranks.select("strategy", *[
        F.greatest(F.col(f"{name}_below") - p, F.lit(p) - F.col(f"{name}_upto"), F.lit(0.0)).alias(f"{name}_error") for name, p in LATENCY_RANKS.items()
    ])


def strategy_ranking(log: DataFrame, sites: DataFrame) -> DataFrame:
    """Per host, strategies ordered by past success rate (then the
    default tier order)."""
    order = F.array_position(F.array(*[F.lit(s) for s in _STRATEGY_ORDER]), F.col("strategy"))
    j = log.join(sites.select("run_id", "hostname"), "run_id")
    rates = j.groupBy("hostname", "strategy").agg(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("rate"))
    w = Window.partitionBy("hostname").orderBy(F.col("rate").desc(), order)
    return rates.select("hostname", "strategy", F.round("rate", 4).alias("success_rate"), F.row_number().over(w).alias("preference"))


# ---------------------------------------------------------------------------
# Conditional requests
# ---------------------------------------------------------------------------
def conditional_savings(outcomes: DataFrame) -> DataFrame:
    """Per run: attempted URLs, not-modified answers, hit rate and the
    bytes of the bodies actually fetched (``body_bytes`` of the capture
    index; no body is read)."""
    o = outcomes.withColumnRenamed("body_bytes", "bytes")
    return o.groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("attempted"),
        F.sum(F.when(F.col("reason") == "not_modified", 1).otherwise(0)).cast("long").alias("not_modified"),
        F.round(F.avg(F.when(F.col("reason") == "not_modified", 1.0).otherwise(0.0)), 4).alias("hit_rate"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "extracted", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_fetched"),
    )


# ---------------------------------------------------------------------------
# Hierarchical sections
# ---------------------------------------------------------------------------
def hierarchical_sections(pages: DataFrame, min_size: int = 2, depth: int = 2) -> DataFrame:
    """Section path = the first ``depth`` path segments; a group smaller
    than ``min_size`` folds up one segment at a time, down to the first."""
    segs = F.split(F.expr(f"btrim({path_sql('url')}, '/')"), "/")
    p = pages.select("run_id", "url", segs.alias("segs"))
    path = F.lit(None).cast("string")
    for level in range(depth, 1, -1):
        p = p.withColumn("cut", F.array_join(F.slice("segs", 1, level), "/"))
        sizes = p.groupBy("run_id", "cut").agg(F.count(F.lit(1)).alias(f"n{level}"))
        p = p.join(sizes, ["run_id", "cut"]).withColumnRenamed("cut", f"cut{level}")
    for level in range(2, depth + 1):
        path = F.when(F.col(f"n{level}") >= min_size, F.col(f"cut{level}")).otherwise(path)
    return p.select("run_id", "url", F.coalesce(path, F.get("segs", 0)).alias("section_path"))


# ---------------------------------------------------------------------------
# Markdown pages
# ---------------------------------------------------------------------------
def markdown_metadata(body: Column) -> tuple[Column, Column]:
    """title = text of the first '# ' heading line; description = the
    first paragraph after it (up to the first blank line), lines joined
    with spaces."""
    title = py_strip(F.regexp_extract(body, r"(?m)^#[ \t]+([^\n]*)$", 1))
    after = F.regexp_replace(body, r"(?s)^.*?(?m:^#[ \t]+[^\n]*$)\n*", "")
    para = F.substring_index(F.regexp_replace(after, r"\r\n", "\n"), "\n\n", 1)
    desc = py_strip(F.regexp_replace(para, r"\n", " "))
    return F.when(title != "", title), F.when(desc != "", desc)


# ---------------------------------------------------------------------------
# Document diff
# ---------------------------------------------------------------------------
def entry_diff(published: DataFrame, generated: DataFrame) -> DataFrame:
    """(run_id, url) of a published and a generated document compared
    with a full outer join: both / published_only / generated_only."""
    a = published.select("run_id", "url", F.lit(True).alias("p")).dropDuplicates(["run_id", "url"])
    b = generated.select("run_id", "url", F.lit(True).alias("g")).dropDuplicates(["run_id", "url"])
    j = a.join(b, ["run_id", "url"], "full_outer")
    return j.select(
        "run_id", "url",
        F.when(F.col("p") & F.col("g"), "both").when(F.col("p").isNotNull(), "published_only").otherwise("generated_only").alias("change"),
    )


def run_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """The pages of two runs of a site (site, url, title, description):
    added, removed, changed (title or description) or same."""
    keys = ["site", "url"]
    cols = ["title", "description"]
    a = before.select(*keys, F.struct(*cols).alias("a"))
    b = after.select(*keys, F.struct(*cols).alias("b"))
    change = (
        F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


# ---------------------------------------------------------------------------
# Recency and stale runs
# ---------------------------------------------------------------------------
def run_recency(runs: DataFrame, now: str, hours: int = RECENT_WINDOW_HOURS) -> DataFrame:
    """X11: runs created within ``hours`` before ``now`` are recent."""
    age = duration_seconds("created_at", f"TIMESTAMP_NTZ'{now}'")
    return runs.select("run_id", F.when(age <= hours * 3600, "recent").otherwise("older").alias("recency"))


def stale_runs(runs: DataFrame, events: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """Queued / running runs whose last event started more than
    ``hours`` before ``now`` (or that have none)."""
    last = events.groupBy("run_id").agg(F.max("started_at").alias("last_event_at"))
    live = runs.filter(F.col("status").isin("queued", "running")).select("run_id", "status")
    j = live.join(last, "run_id", "left")
    age = duration_seconds("last_event_at", f"TIMESTAMP_NTZ'{now}'")
    return j.select("run_id", "status", "last_event_at", (F.col("last_event_at").isNull() | (age > hours * 3600)).alias("stale"))


# ---------------------------------------------------------------------------
# Freshness-weighted importance
# ---------------------------------------------------------------------------
def http_date(col: str) -> Column:
    """RFC 1123 date text ('Mon, 01 Jan 2024 00:00:00 GMT') -> TIMESTAMP_NTZ (UTC)."""
    return F.to_timestamp(F.regexp_extract(F.col(col), r",\s*(.*?)\s*GMT", 1), "dd MMM yyyy HH:mm:ss").cast("timestamp_ntz")


def fresh_importance(ranked: DataFrame, index: DataFrame, now: str, half_life_days: float = 30.0) -> DataFrame:
    """In-links weighted by 0.5 ** (age / half-life), age from the
    capture's Last-Modified (weight 1 without one)."""
    lm = index.select(F.col("url_key"), http_date("last_modified").alias("lm"))
    j = ranked.join(lm, "url_key", "left")
    age_days = duration_seconds("lm", f"TIMESTAMP_NTZ'{now}'") / 86400.0
    weight = F.coalesce(F.pow(F.lit(0.5), age_days / half_life_days), F.lit(1.0))
    return j.select("site", "url_key", F.round(F.col("inlinks") * weight, 6).alias("fresh_score"))


# ---------------------------------------------------------------------------
# Politeness plan
# ---------------------------------------------------------------------------
def politeness_plan(discovered: DataFrame, delay_ms: int = 10) -> DataFrame:
    """Per site, the fetch offset of each URL in discovery order
    (exact positions without sorting a whole site in one task)."""
    from sitelens.functions.ordering import keyed_row_number

    n = keyed_row_number(discovered.select("run_id", "url", "ord"), ["run_id"], ["ord", "url"], "pos")
    return n.select("run_id", "url", ((F.col("pos") - 1) * delay_ms).cast("long").alias("offset_ms"))

