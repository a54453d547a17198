"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or inputs Spark derives from them)
and runs over all rows.  Column names match ``sitelens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.config import PipelineParams
from sitelens.functions import text as textfn
from sitelens.functions import urls as U
from sitelens.operators import audit, canonical, document, extract, insights, linkgraph, views
from sitelens.operators.discovery import discovery_milestones, expand_sitemaps, fetch_bodies, site_bases
from sitelens.plans import jobs
from sitelens.session import materialize, prepare_session
from sitelens.sources import fixtures as fx
from sitelens.sources import sitelist, store
from sitelens.sources.captures import CAPTURE_SCHEMA, header
from sitelens.sources.keyed import KeyedTable
from sitelens.sources.tables import read_table
from sitelens.streaming import monitor

#: Buckets of the keyed tables that the registered queries write.
STORE_BUCKETS = 16

Query = Callable[[SparkSession, str], DataFrame]


def _captured(spark: SparkSession, sf: str) -> jobs.StageResult:
    """Captured-pages run; the derived captures are written once (they are
    read by the capture index and by the HTML pass)."""
    prepare_session(spark)
    caps = materialize(fx.page_captures(spark, sf), "page-captures")
    return jobs.index_captured_pages(fx.sites(spark, sf), caps, PipelineParams())


def q_site_index_captured(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: one llms.txt per host from its captured pages."""
    return _captured(spark, sf).artifacts


def q_site_scores_captured(spark: SparkSession, sf: str) -> DataFrame:
    """C3 scores of every host's captured pages."""
    return _captured(spark, sf).scores


_FULL_RUN_CACHE: dict[tuple[str, str], jobs.FullResult] = {}


def crawl_inputs(spark: SparkSession, sf: str):
    """Sites, all captured responses, and the discovery-file captures of the
    crawl fixture, written once per session to the checkpoint folder."""
    prepare_session(spark)
    sites = materialize(fx.sites(spark, sf), "sites")
    pages = materialize(fx.page_captures(spark, sf, link_graph=True), "page-captures")
    files = materialize(fx.discovery_captures(spark, sf), "discovery-files")
    return sites, pages.unionByName(files), files


def full_run(spark: SparkSession, sf: str) -> jobs.FullResult:
    """All five stages over the crawl fixture; shared by the queries that
    read one of its outputs within a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FULL_RUN_CACHE:
        sites, caps = crawl_inputs_cached(spark, sf)
        files = _INPUT_CACHE[key][2]
        _FULL_RUN_CACHE[key] = jobs.run_all_stages(sites, caps, PipelineParams(), files=files)
    return _FULL_RUN_CACHE[key]


def q_site_index_tiered(spark: SparkSession, sf: str) -> DataFrame:
    """All stages: tiered discovery -> extraction -> canonical pages ->
    scores -> one llms.txt per site."""
    return full_run(spark, sf).stages.artifacts


# ---------------------------------------------------------------------------
# Per-operator views of the full pipeline (discovery, scan, extraction,
# canonical pages, documents, milestones)
# ---------------------------------------------------------------------------



def _key_text(c: str = "ord.key") -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ".")


def q_d1_llms_links(spark, sf):
    """Links listed in each site's llms.txt (first [text](href) per
    line, resolved against the site), invalid ones included."""
    c = full_run(spark, sf).discovery.candidates
    return c.filter(F.col("source") == "llms").select("run_id", "raw_url", F.col("ord.key")[0].alias("line_no"))


def q_d2_robots_hints(spark, sf):
    """D2: 'llms:' hints of robots.txt (column-0 keyword, any case)."""
    c = full_run(spark, sf).discovery.candidates
    return c.filter(F.col("source") == "robots").select("run_id", "raw_url", F.col("ord.key")[0].alias("line_no"))


def q_d4_sitemap_urls(spark, sf):
    """URLs from robots-listed and well-known sitemaps, sitemap
    indexes expanded depth-first with the cycle guard."""
    c = full_run(spark, sf).discovery.candidates
    return c.filter(F.col("source") == "sitemap").select(
        "run_id", "raw_url", F.col("ord.tier").alias("tier"), _key_text().alias("ord_key")
    )


def q_d4_deep_sitemaps(spark, sf):
    """Sitemap indexes nested eight levels deep, expanded to the end."""
    prepare_session(spark)
    files = materialize(fx.deep_sitemap_captures(spark, sf), "deep-sitemaps")
    roots = site_bases(fx.sites(spark, sf)).select(
        "run_id", F.lit(3).alias("tier"), F.array().cast("array<long>").alias("key"), F.concat("base", F.lit("/deep-0.xml")).alias("sitemap_url")
    )
    found = expand_sitemaps(roots, files, materialize(extract.capture_index(files), "deep-index"))
    return found.select("run_id", "raw_url", _key_text().alias("ord_key"))


def q_d4_mutual_sitemaps(spark, sf):
    """Five sitemap indexes per host that all list each other, each read once."""
    prepare_session(spark)
    files = materialize(fx.mutual_sitemap_captures(spark, sf), "mutual-sitemaps")
    roots = site_bases(fx.sites(spark, sf)).select(
        "run_id", F.lit(3).alias("tier"), F.array().cast("array<long>").alias("key"), F.concat("base", F.lit("/mutual-0.xml")).alias("sitemap_url")
    )
    found = expand_sitemaps(roots, files, materialize(extract.capture_index(files), "mutual-index"))
    return found.select("run_id", "raw_url", _key_text().alias("ord_key"))


def q_d6_tier_gate(spark, sf):
    """Strategies that ran per site under the tier gate."""
    log = full_run(spark, sf).discovery.strategy_log
    return log.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("strategy")), ",").alias("strategies"))


def q_d8_discovered(spark, sf):
    """De-duplicated discovered URLs, first source wins."""
    d = full_run(spark, sf).discovery.discovered
    return d.select("run_id", "url", "provenance", F.col("ord.tier").alias("tier"), _key_text().alias("ord_key"))


def q_d9_spider_top(spark, sf):
    """The 50 most important scanned URLs per site."""
    scan = full_run(spark, sf).discovery.scan
    return linkgraph.top_pages(scan, 50).select(
        F.col("site").alias("run_id"), F.col("url_key").alias("url"), "importance", "inlinks", "depth"
    )


def q_d10_strategy_log(spark, sf):
    """Success, failed-probe status and URL count per strategy run."""
    return full_run(spark, sf).discovery.strategy_log


def q_g1_page_links(spark, sf):
    """G1: filtered same-domain links of every expanded page, in order."""
    e = full_run(spark, sf).discovery.scan.edges
    w = F.row_number().over(Window.partitionBy("site", "src").orderBy("pos"))
    return e.select(F.col("site").alias("run_id"), "src", "dst", w.alias("link_order"))


def q_g2_bfs_visited(spark, sf):
    """URLs visited by the bounded BFS with depth, BFS rank and
    whether they expanded."""
    v = full_run(spark, sf).discovery.scan.visited
    return v.select(F.col("site").alias("run_id"), F.col("url_key").alias("url"), "depth", F.col("rank").alias("bfs_rank"), "expanded")


def q_g2_bfs_budget(spark, sf):
    """G2 with a binding page budget (10): the scan of every spider site
    stops after its first ten URLs in FIFO order, failures included."""
    from sitelens.config import SpiderBounds

    run = full_run(spark, sf)
    sites, _caps = crawl_inputs_cached(spark, sf)
    spider_runs = run.discovery.strategy_log.filter(F.col("strategy") == "spider").select("run_id")
    seeds = sites.join(spider_runs, "run_id", "left_semi").select(
        F.col("run_id").alias("site"), "hostname", F.col("target_url").alias("seed_url")
    )
    scan = linkgraph.bfs_scan(seeds, run.index, run.stages.signals, SpiderBounds(max_depth=3, max_scan_pages=10))
    return scan.visited.select(F.col("site").alias("run_id"), F.col("url_key").alias("url"), "depth", F.col("rank").alias("bfs_rank"))


def q_g3_inlinks(spark, sf):
    """In-link counts of visited URLs."""
    scan = full_run(spark, sf).discovery.scan
    return linkgraph.inlink_counts(scan).select(F.col("site").alias("run_id"), F.col("url_key").alias("url"), "inlinks")


def q_g4_importance(spark, sf):
    """Importance rank (in-links desc, depth, URL) of visited URLs."""
    scan = full_run(spark, sf).discovery.scan
    return linkgraph.rank_pages(scan).select(
        F.col("site").alias("run_id"), F.col("url_key").alias("url"), "importance", "inlinks", "depth"
    )


def q_g6_scan_audit(spark, sf):
    """Per scanned page: depth, links found, in-link score at scan time."""
    scan = full_run(spark, sf).discovery.scan
    return linkgraph.page_scan_audit(scan).select(
        F.col("site").alias("run_id"), F.col("url_key").alias("url"), "depth", "links_found", "inlink_score"
    )


def q_g7_scan_summary(spark, sf):
    """Pages scanned and unique link targets per scanned site."""
    scan = full_run(spark, sf).discovery.scan
    return linkgraph.scan_summary(scan).withColumnRenamed("site", "run_id").drop("duration_seconds")


def q_l11_batch_spans(spark, sf):
    """The stage events that the batch itself wrote, per run."""
    ev = full_run(spark, sf).trail.events.filter(F.col("name").startswith("stage."))
    return ev.select(
        "run_id", "name", "system", F.get_json_object("metadata", "$.outcome").alias("outcome"),
        (F.col("completed_at") >= F.col("started_at")).alias("closed"),
    )


def q_s5_batch_transitions(spark, sf):
    """Work items of the batch and their state changes, in order."""
    trail = full_run(spark, sf).trail
    t = trail.transitions.join(trail.work_items.select(F.col("id").alias("work_item_id"), "run_id", "stage", "state"), "work_item_id")
    return t.select("run_id", "stage", "seq", "from_state", "to_state", "state")


def q_v1_batch_runs(spark, sf):
    """V1: the runs that the batch completed, with their scores."""
    return full_run(spark, sf).trail.runs.select("run_id", "hostname", "status", "score", F.col("completed_at").isNotNull().alias("done"))


def q_c2_write_back(spark, sf):
    """Stored pages after the canonical pages replaced those of their run."""
    st = full_run(spark, sf).stages
    old = st.pages.select("run_id", "url", "title").unionByName(
        st.pages.select(F.concat(F.lit("other-"), "run_id").alias("run_id"), "url", "title"))
    return canonical.write_back(old, st.canonical_pages.select("run_id", "url", "title"))


def q_e9_single_page(spark, sf):
    """The record of the page with the largest id among those answered
    with 200, from a lookup of its URL alone."""
    prepare_session(spark)
    row = read_table(spark, sf, "pages").filter((F.col("page_id") % 10 != 0) & (F.col("page_id") % 11 != 0)).agg(
        F.max_by("url", "page_id").alias("url")).first()
    p = extract.index_page(row.url.partition("#")[0], fx.page_captures(spark, sf), "single")
    return p.select("run_id", "url", "title", F.col("provenance.title").alias("title_source"), F.col("confidence.title").alias("title_confidence"))


def q_e6_incremental_pages(spark, sf):
    """Pages of an incremental run; unchanged pages are not parsed."""
    run = full_run(spark, sf)
    sites, caps = crawl_inputs_cached(spark, sf)
    st = jobs.finish_sites(sites, run.discovery.discovered, caps, PipelineParams(incremental=True), fx.validators(spark, sf), index=run.index)
    parsed = st.signals.select("url_key", F.lit(True).alias("parsed"))
    return st.pages.join(parsed, "url_key", "full_outer").select("run_id", "url", "title", "parsed")


def q_e7_outcomes(spark, sf):
    """Extraction outcome per discovered URL."""
    o = full_run(spark, sf).stages.outcomes
    return o.select("run_id", "url", "outcome", "reason", F.col("outcome_status").alias("status_code"))


def q_e6_incremental_outcomes(spark, sf):
    """Outcomes of an incremental run; a stored validator equal to the
    capture's answers not-modified."""
    run = full_run(spark, sf)
    o = extract.extraction_outcomes(run.discovery.discovered, run.index, fx.validators(spark, sf), incremental=True)
    return o.select("run_id", "url", "outcome", "reason", F.col("outcome_status").alias("status_code"))


def q_e8_pages(spark, sf):
    """Page records with provenance and confidence."""
    p = full_run(spark, sf).stages.pages
    return p.select(
        "run_id", "url", "title", "description",
        F.col("provenance.discovery").alias("discovery"),
        F.col("provenance.title").alias("title_source"),
        F.col("confidence.title").alias("title_confidence"),
        F.col("provenance.description").alias("description_source"),
        F.col("confidence.description").alias("description_confidence"),
    )


def q_e10_validators(spark, sf):
    """Validators taken from the responses of extracted pages."""
    st = full_run(spark, sf).stages
    v = st.outcomes.filter(F.col("outcome") == "extracted")
    return v.select("run_id", "url", "etag", "last_modified")


def q_c1_canonical_pages(spark, sf):
    """One page per canonical URL (best confidence, first on ties)."""
    c = full_run(spark, sf).stages.canonical_pages
    return c.select("run_id", "url", "title", F.col("ord.tier").alias("tier"), _key_text().alias("ord_key"))


def q_c3_scores(spark, sf):
    """Coverage / confidence / redundancy / total per site."""
    return full_run(spark, sf).stages.scores


def q_c4_sections(spark, sf):
    """C4: sections per site with their order and entry counts."""
    st = full_run(spark, sf)
    sites, _caps = crawl_inputs_cached(spark, sf)
    e = document.sectioned_entries(st.stages.canonical_pages, sites)
    agg = e.groupBy("run_id", "section").agg(F.min("sec_ord").alias("sec_ord"), F.count(F.lit(1)).cast("long").alias("entries"))
    w = Window.partitionBy("run_id").orderBy("sec_ord")
    return agg.select("run_id", "section", F.row_number().over(w).alias("section_order"), "entries")


def q_c5_document_lines(spark, sf):
    """C5 in distributed form: every line of every document with its number,
    without collecting a site into one row."""
    from sitelens.functions.ordering import keyed_row_number

    st = full_run(spark, sf)
    sites, _caps = crawl_inputs_cached(spark, sf)
    counts = st.discovery.discovered.groupBy("run_id").agg(F.count(F.lit(1)).cast("long").alias("links_discovered"))
    lines = document.document_lines(st.stages.canonical_pages, sites, counts)
    parts = lines.select("run_id", "k0", "k1", "k2", "k3", F.posexplode(F.split("line", "\n")).alias("k4", "line"))
    numbered = keyed_row_number(parts, ["run_id"], ["k0", "k1", "k2", "k3", "k4"], "line_no")
    return numbered.select("run_id", F.col("line_no").cast("long").alias("line_no"), "line")


def q_c6_site_meta(spark, sf):
    """Site title / description from the home page, page and link counts."""
    st = full_run(spark, sf)
    sites, _caps = crawl_inputs_cached(spark, sf)
    counts = st.discovery.discovered.groupBy("run_id").agg(F.count(F.lit(1)).cast("long").alias("links_discovered"))
    return document.site_meta(st.stages.canonical_pages, sites, counts).drop("hostname")


def q_c7_artifact_stats(spark, sf):
    """Bytes, entries, lines and words of each document, from its lines."""
    st = full_run(spark, sf).stages
    return document.document_stats(st.lines, st.site_meta)


def q_c5_line_offsets(spark, sf):
    """Number and first byte of every line of every document."""
    return document.document_offsets(full_run(spark, sf).stages.lines)


def q_v11_line_preview(spark, sf):
    """Line count and the first 20 lines of every rendered document."""
    return document.document_previews(document.document_offsets(full_run(spark, sf).stages.lines), max_lines=20)


def q_l7_discovery_milestone(spark, sf):
    """URLs discovered and sources used per run."""
    sites, _caps = crawl_inputs_cached(spark, sf)
    return discovery_milestones(full_run(spark, sf).discovery.discovered, sites)


def q_l8_extraction_milestone(spark, sf):
    """Pages extracted and skipped per run."""
    sites, _caps = crawl_inputs_cached(spark, sf)
    return extract.extraction_milestones(full_run(spark, sf).stages.outcomes, sites)


def q_l9_generation_milestone(spark, sf):
    """Document bytes, entry count and pages indexed per run."""
    a = full_run(spark, sf).stages.artifacts
    return a.select("run_id", F.col("size_bytes").alias("llmstxt_size_bytes"), "entry_count",
                    F.col("entry_count").alias("total_pages_indexed"))


_INPUT_CACHE: dict = {}


def crawl_inputs_cached(spark, sf):
    """(sites, captures) of the crawl fixture; the discovery files are the
    third element of the cached triple."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INPUT_CACHE:
        _INPUT_CACHE[key] = crawl_inputs(spark, sf)
    return _INPUT_CACHE[key][:2]


STAGE_QUERIES = {
    "d1_llms_links": q_d1_llms_links,
    "d2_robots_hints": q_d2_robots_hints,
    "d4_sitemap_urls": q_d4_sitemap_urls,
    "d4_deep_sitemaps": q_d4_deep_sitemaps,
    "d4_mutual_sitemaps": q_d4_mutual_sitemaps,
    "d6_tier_gate": q_d6_tier_gate,
    "d8_discovered": q_d8_discovered,
    "d9_spider_top": q_d9_spider_top,
    "d10_strategy_log": q_d10_strategy_log,
    "g1_page_links": q_g1_page_links,
    "g2_bfs_visited": q_g2_bfs_visited,
    "g2_bfs_budget": q_g2_bfs_budget,
    "g3_inlinks": q_g3_inlinks,
    "g4_importance": q_g4_importance,
    "g6_scan_audit": q_g6_scan_audit,
    "g7_scan_summary": q_g7_scan_summary,
    "e6_incremental_outcomes": q_e6_incremental_outcomes,
    "e7_outcomes": q_e7_outcomes,
    "e6_incremental_pages": q_e6_incremental_pages,
    "e9_single_page": q_e9_single_page,
    "c2_write_back": q_c2_write_back,
    "l11_batch_spans": q_l11_batch_spans,
    "s5_batch_transitions": q_s5_batch_transitions,
    "v1_batch_runs": q_v1_batch_runs,
    "e8_pages": q_e8_pages,
    "e10_validators": q_e10_validators,
    "c1_canonical_pages": q_c1_canonical_pages,
    "c3_scores": q_c3_scores,
    "c4_sections": q_c4_sections,
    "c5_document_lines": q_c5_document_lines,
    "c6_site_meta": q_c6_site_meta,
    "c7_artifact_stats": q_c7_artifact_stats,
    "c5_line_offsets": q_c5_line_offsets,
    "v11_line_preview": q_v11_line_preview,
    "l7_discovery_milestone": q_l7_discovery_milestone,
    "l8_extraction_milestone": q_l8_extraction_milestone,
    "l9_generation_milestone": q_l9_generation_milestone,
}


def _as_long(fn: Query) -> Query:
    """Integer outputs as BIGINT so the schema matches SQL engines that
    widen counts and ranks."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = fn(spark, sf)
        cols = [
            F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name)
            for f in df.schema.fields
        ]
        return df.select(*cols)

    run.__doc__ = fn.__doc__
    run.__name__ = getattr(fn, "__name__", "query")
    return run


# ---------------------------------------------------------------------------
# Extraction cascade over documents rendered as HTML
# ---------------------------------------------------------------------------
_CASCADE_CACHE: dict = {}


def cascade_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sites and captures of the documents as pages.  A page holds its text
    twice; the pages are rendered by the scans that read them, not stored."""
    prepare_session(spark)
    return materialize(fx.cascade_sites(spark, sf), "cascade-sites"), fx.cascade_captures(spark, sf)


def cascade_result(spark: SparkSession, sf: str) -> jobs.StageResult:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CASCADE_CACHE:
        _CASCADE_CACHE[key] = jobs.index_captured_pages(*cascade_inputs(spark, sf), PipelineParams())
    return _CASCADE_CACHE[key]


def q_e1_signals(spark, sf):
    """Head-scoped title, meta count and JSON-LD values of each page."""
    s = jobs.captured_page_signals(*cascade_inputs(spark, sf), PipelineParams())
    return s.select(
        F.col("url_key").alias("url"), "has_head", "title", F.size("metas").alias("meta_count"),
        "ld_headline", "ld_description",
    )


def q_e2_cascade(spark, sf):
    """Title and description cascades with source and confidence."""
    p = cascade_result(spark, sf).pages
    return p.select(
        "url", "title", F.col("provenance.title").alias("title_source"), F.col("confidence.title").alias("title_confidence"),
        "description", F.col("provenance.description").alias("description_source"),
        F.col("confidence.description").alias("description_confidence"),
    )


def q_e11_page_events(spark, sf):
    """Per-page audit events; descriptions cut to 120 characters."""
    e = cascade_result(spark, sf).events
    return e.select(
        "id", "run_id", "name", "system", "started_at", "completed_at",
        F.get_json_object("metadata", "$.url").alias("url"),
        F.get_json_object("metadata", "$.title_source").alias("title_source"),
        F.get_json_object("metadata", "$.description").alias("description"),
        F.get_json_object("metadata", "$.description_source").alias("description_source"),
    )


# ---------------------------------------------------------------------------
# URL scalars over the driver pages
# ---------------------------------------------------------------------------

_CAPTURED_CACHE: dict = {}


def captured_result(spark: SparkSession, sf: str) -> jobs.StageResult:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CAPTURED_CACHE:
        _CAPTURED_CACHE[key] = _captured(spark, sf)
    return _CAPTURED_CACHE[key]


def q_p1_url_parts(spark, sf):
    """Scheme / netloc / path / query / fragment of every page URL."""
    p = read_table(spark, sf, "pages")
    return p.select(
        "page_id", U.url_scheme("url").alias("scheme"), U.url_netloc("url").alias("netloc"),
        U.url_path("url").alias("path"), U.url_query("url").alias("query"), U.url_fragment("url").alias("fragment"),
    )


_SIGNALS_CACHE: dict = {}


def captured_signals(spark: SparkSession, sf: str) -> DataFrame:
    """HTML signals of the captured driver pages (E1 only, written once)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SIGNALS_CACHE:
        prepare_session(spark)
        caps = fx.page_captures(spark, sf)
        _SIGNALS_CACHE[key] = materialize(extract.page_signals(caps), "page-signals")
    return _SIGNALS_CACHE[key]


def _page_hrefs(spark, sf):
    s = captured_signals(spark, sf)
    return s.select(F.col("url_key").alias("page_url"), F.posexplode(F.arrays_zip("hrefs", "links")).alias("pos", "h")).select(
        "page_url", "pos", F.col("h.hrefs").alias("href"), F.col("h.links").alias("link")
    )


def q_p2_resolve_hrefs(spark, sf):
    """Every anchor href of every page resolved against the page URL."""
    h = _page_hrefs(spark, sf)
    return h.select("page_url", "pos", "href", U.resolve_url(F.col("page_url"), F.col("href")).alias("resolved"))


def q_p3_canonical(spark, sf):
    """Canonical form of every page URL."""
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", U.canonical_url("url").alias("canonical_url"))


def q_p4_link_filters(spark, sf):
    """Fragment strip, same-domain, suffix / allow list and
    non-content tests of every resolved link."""
    h = _page_hrefs(spark, sf).withColumn("hostname", U.url_netloc("page_url"))
    exts = sorted({".html", ".htm", ".txt", ".md", ""})
    return h.select(
        "page_url", "pos", "link",
        U.strip_fragment("link").alias("link_no_fragment"),
        U.same_domain(U.netloc_sql("link"), "hostname").alias("same_domain"),
        U.path_suffix(U.path_sql("link")).alias("suffix"),
        U.extension_allowed(U.path_sql("link"), exts).alias("extension_allowed"),
        U.non_content_path(U.path_sql("link")).alias("non_content"),
    )


def q_p8_section_names(spark, sf):
    """Section of every page's canonical URL within its host."""
    p = read_table(spark, sf, "pages").select("page_id", U.canonical_url("url").alias("url"), fx.host_of("url").alias("hostname"))
    return p.select("page_id", "url", U.section_name("url", "hostname").alias("section"))


def q_p9_normalized_links(spark, sf):
    """Validity and serialisation of every resolved link."""
    h = _page_hrefs(spark, sf)
    return h.select("page_url", "pos", "link", U.valid_http_url("link").alias("valid"), U.normalize_http_url("link").alias("normalized"))


def q_p10_home_pages(spark, sf):
    """P10: home-page test of every canonical page of the pipeline."""
    st = full_run(spark, sf)
    sites, _ = crawl_inputs_cached(spark, sf)
    c = st.stages.canonical_pages.join(sites.select("run_id", "hostname"), "run_id")
    return c.select("run_id", "url", U.is_home("url", "hostname").alias("is_home"))


def q_p11_lines(spark, sf):
    """Every line of every document (whole texts, splitlines rules)."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(textfn.split_lines("text")).alias("line_no", "line"))


def q_p12_content_types(spark, sf):
    """Content type of every captured response and the text test."""
    _sites, caps = crawl_inputs_cached(spark, sf)
    ct = header("content-type")
    return caps.select("url", ct.alias("content_type"), (ct.contains("text/html") | ct.contains("text/plain")).alias("is_text"))


def q_p13_entry_titles(spark, sf):
    """Entry title falls back to the URL."""
    c = full_run(spark, sf).stages.canonical_pages
    return c.select("run_id", "url", F.coalesce(F.expr("nullif(title, '')"), F.col("url")).alias("entry_title"))


SCALAR_QUERIES = {
    "e1_signals": q_e1_signals,
    "e2_cascade": q_e2_cascade,
    "e11_page_events": q_e11_page_events,
    "p1_url_parts": q_p1_url_parts,
    "p2_resolve_hrefs": q_p2_resolve_hrefs,
    "p3_canonical": q_p3_canonical,
    "p4_link_filters": q_p4_link_filters,
    "p8_section_names": q_p8_section_names,
    "p9_normalized_links": q_p9_normalized_links,
    "p10_home_pages": q_p10_home_pages,
    "p11_lines": q_p11_lines,
    "p12_content_types": q_p12_content_types,
    "p13_entry_titles": q_p13_entry_titles,
}


# ---------------------------------------------------------------------------
# Audit trail: metrics (L) and read views (V) over the event-derived log
# ---------------------------------------------------------------------------

NOW = "2024-02-01 00:00:00"


def _submissions(spark, sf):
    """Submitted target URLs: every page URL and every raw anchor href."""
    pages = read_table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("submission_id"), "url")
    hrefs = _page_hrefs(spark, sf).select(
        F.concat(F.lit("h"), "pos", F.lit("@"), "page_url").alias("submission_id"), F.col("href").alias("url")
    )
    return pages.unionByName(hrefs)


def q_s1_accept_targets(spark, sf):
    """Submitted URLs accepted as queued runs or rejected with a reason."""
    runs, _items, rejects = store.accept_targets(_submissions(spark, sf))
    acc = runs.select("submission_id", F.col("target_url").alias("url"), F.lit(True).alias("accepted"), "run_id", "hostname",
                      F.lit(None).cast("string").alias("reason"))
    rej = rejects.select("submission_id", "url", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("run_id"),
                         F.lit(None).cast("string").alias("hostname"), "reason")
    return acc.unionByName(rej)


def q_s1_work_items(spark, sf):
    """The queued discovery item of every accepted submission."""
    _runs, items, _rejects = store.accept_targets(_submissions(spark, sf))
    return items.select("id", "run_id", "stage", "state", "url", "attempt_count", "priority")


def q_l1_transition_violations(spark, sf):
    """L1: transitions the work-item state machine forbids."""
    return audit.transition_violations(fx.work_item_transitions(spark, sf))


def q_l2_state_gauge(spark, sf):
    """L2: items currently in each state."""
    return audit.state_gauge(fx.work_item_transitions(spark, sf))


def q_l3_run_outcomes(spark, sf):
    """L3: finished runs by outcome."""
    return audit.run_outcomes(fx.runs(spark, sf))


def q_l4_stage_outcomes(spark, sf):
    """L4: stage executions by stage and outcome."""
    return audit.stage_outcomes(fx.crawl_events(spark, sf))


def q_l5_stage_durations(spark, sf):
    """Duration distribution of successful stage executions."""
    return audit.stage_durations(fx.crawl_events(spark, sf))


def q_l6_business_metrics(spark, sf):
    """Pages indexed, run durations and artifact sizes."""
    return audit.business_metrics(fx.runs(spark, sf), fx.crawl_events(spark, sf), fx.artifacts(spark, sf))


def q_l12_event_durations(spark, sf):
    """Event durations (NULL while open)."""
    return audit.event_durations(fx.crawl_events(spark, sf))


def q_l13_log_lines(spark, sf):
    """JSON log line per event with sorted keys."""
    return audit.log_lines(fx.crawl_events(spark, sf))


def q_l14_failure_codes(spark, sf):
    """Failure classes with their HTTP-like codes and counts."""
    _runs, _items, rejects = store.accept_targets(_submissions(spark, sf))
    runs, arts = fx.runs(spark, sf), fx.artifacts(spark, sf)
    # A document is requested for every user and for every event id as a run.
    asked = read_table(spark, sf, "events").select(
        F.explode(F.array(F.concat(F.lit("run-"), "user_id"), F.concat(F.lit("run-e"), "event_id"))).alias("run_id")
    ).distinct()
    return audit.failure_codes(fx.crawl_events(spark, sf), rejects, audit.missing_documents(asked, runs, arts))


def q_v1_run_status(spark, sf):
    """V1: status of every run."""
    return views.run_status(fx.runs(spark, sf))


def q_v2_history(spark, sf):
    """V2: the 50 newest runs (history report)."""
    return views.history(fx.runs(spark, sf))


def q_v3_work_items(spark, sf):
    """V3: work items of each run by creation time."""
    return views.work_items_in_order(fx.work_items(spark, sf))


def q_v4_events(spark, sf):
    """V4: events of each run by start time with durations."""
    return views.events_in_order(fx.crawl_events(spark, sf))


def q_v5_artifacts(spark, sf):
    """V5: document text of each completed run."""
    return views.artifact_text(fx.artifacts(spark, sf))


def q_v6_stage_states(spark, sf):
    """V6: state of the five stages of every run."""
    return views.stage_states(fx.runs(spark, sf), fx.work_items(spark, sf))


def q_v7_current_stage(spark, sf):
    """V7: current stage label of every run."""
    return views.current_stage(views.stage_states(fx.runs(spark, sf), fx.work_items(spark, sf)))


def q_v8_timeline(spark, sf):
    """V8: one item per stage and run for the timeline."""
    return views.timeline(fx.work_items(spark, sf))


def q_v9_recent_events(spark, sf):
    """V9: the 8 most recent events of every run."""
    return views.recent_events(fx.crawl_events(spark, sf))


def q_v10_event_table(spark, sf):
    """Full event table with rounded milliseconds and details."""
    return views.event_table(fx.crawl_events(spark, sf))


def q_v11_artifact_preview(spark, sf):
    """Lines, words and preview of every document."""
    return views.artifact_preview(fx.artifacts(spark, sf))


def q_v12_run_groups(spark, sf):
    """Active versus history runs."""
    return views.run_groups(fx.runs(spark, sf))


def q_v13_status_summary(spark, sf):
    """Status summary and exit code over all runs."""
    return views.status_summary(fx.runs(spark, sf))


def q_v14_stage_events(spark, sf):
    """The last five stage events of every run."""
    return views.last_stage_events(fx.crawl_events(spark, sf))


def q_v15_run_labels(spark, sf):
    """Elapsed-time and score labels of every run."""
    return views.run_labels(fx.runs(spark, sf), NOW)


AUDIT_QUERIES = {
    "s1_accept_targets": q_s1_accept_targets,
    "s1_work_items": q_s1_work_items,
    "l1_transition_violations": q_l1_transition_violations,
    "l2_state_gauge": q_l2_state_gauge,
    "l3_run_outcomes": q_l3_run_outcomes,
    "l4_stage_outcomes": q_l4_stage_outcomes,
    "l5_stage_durations": q_l5_stage_durations,
    "l6_business_metrics": q_l6_business_metrics,
    "l12_event_durations": q_l12_event_durations,
    "l13_log_lines": q_l13_log_lines,
    "l14_failure_codes": q_l14_failure_codes,
    "v1_run_status": q_v1_run_status,
    "v2_history": q_v2_history,
    "v3_work_items": q_v3_work_items,
    "v4_events": q_v4_events,
    "v5_artifacts": q_v5_artifacts,
    "v6_stage_states": q_v6_stage_states,
    "v7_current_stage": q_v7_current_stage,
    "v8_timeline": q_v8_timeline,
    "v9_recent_events": q_v9_recent_events,
    "v10_event_table": q_v10_event_table,
    "v11_artifact_preview": q_v11_artifact_preview,
    "v12_run_groups": q_v12_run_groups,
    "v13_status_summary": q_v13_status_summary,
    "v14_stage_events": q_v14_stage_events,
    "v15_run_labels": q_v15_run_labels,
}


# ---------------------------------------------------------------------------
# Structured Streaming (R1-R5): each query drains a file stream written in
# micro-batches (availableNow) and returns the sink table
# ---------------------------------------------------------------------------

_EV_COLS = ["id", "run_id", "name", "system", "started_at", "completed_at", "metadata"]


def _event_batches(spark, sf, with_copies: bool):
    """Three micro-batches of the event log.

    1: every event but the five newest (with ``with_copies``, plus a
       redelivered copy of each ``event_id % 20 = 0``);
    2: the five newest events (plus copies of the five newest of batch 1:
       redelivery across batches);
    3: one event dated a day before the log starts.  Since Spark 3.4 late
       rows are judged against the previous batch's watermark, so the late
       row needs two batches before it.
    """
    ev = fx.crawl_events(spark, sf).select(*_EV_COLS)
    num = F.substring_index("id", "-", -1).cast("long")
    newest = ev.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(5)
    older = ev.join(newest.select("id"), "id", "left_anti").select(*_EV_COLS)
    tail = older.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(5)
    late = ev.orderBy("started_at", "id").limit(1).select(
        F.lit("ev-late").alias("id"), "run_id", "name", "system",
        F.expr("started_at - INTERVAL 1 DAY").alias("started_at"), "completed_at", "metadata",
    )
    if with_copies:
        first = older.unionByName(older.filter(num % 20 == 0))
        second = newest.unionByName(tail)
    else:
        first, second = older, newest
    return ev.schema, [first, second, late]


def q_r1_dedup_events(spark, sf):
    """Live event feed de-duplicated by id under redelivery; the late
    event is dropped by the watermark."""
    prepare_session(spark)
    schema, batches = _event_batches(spark, sf, with_copies=True)
    out = monitor.replay(spark, batches, schema, "r1", monitor.dedup_events)
    return monitor.read_table(spark, out, "id string", key=["id"]).select("id", "run_id", "name", "started_at")


def q_r2_stage_throughput(spark, sf):
    """R2: executions and failures per stage and day (tumbling windows,
    update mode upserted by window and stage)."""
    prepare_session(spark)
    schema, batches = _event_batches(spark, sf, with_copies=False)
    out = monitor.replay(spark, batches, schema, "r2", monitor.stage_throughput, mode="update")
    return monitor.read_table(spark, out, "window_start timestamp_ntz", key=["window_start", "stage"])


def q_r2_sliding(spark, sf):
    """R2: executions and failures per stage in two-hour windows that start
    every hour (update mode upserted by window and stage)."""
    prepare_session(spark)
    schema, batches = _event_batches(spark, sf, with_copies=False)
    build = lambda s: monitor.stage_throughput(s, "2 hours", "1 hour")
    out = monitor.replay(spark, batches, schema, "r2s", build, mode="update")
    return monitor.read_table(spark, out, "window_start timestamp_ntz", key=["window_start", "stage"])


def q_r3_activity_sessions(spark, sf):
    """Activity sessions per run (30-minute gap) as a streaming query in
    append mode: a session is emitted once, when the watermark passes its
    end.  The input layout ends with two clock events of a separate key
    (a day and two days after the log) so the watermark moves past every
    real session before the input is drained; their own sessions are not
    part of the answer."""
    prepare_session(spark)
    ev = fx.crawl_events(spark, sf).select(*_EV_COLS)
    last = ev.agg(F.max("started_at").alias("t"))

    def clock(days: int):
        return last.select(
            F.lit(f"clock-{days}").alias("id"), F.lit("__clock__").alias("run_id"), F.lit("clock").alias("name"),
            F.lit("clock").alias("system"), F.expr(f"t + INTERVAL {days} DAY").alias("started_at"),
            F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit("{}").alias("metadata"),
        )

    build = lambda s: monitor.activity_sessions(s, delay="10 minutes")
    out = monitor.replay(spark, [ev, clock(1), clock(2)], ev.schema, "r3", build)
    got = monitor.read_table(spark, out, "run_id string, session_start timestamp_ntz, session_end timestamp_ntz, events long")
    return got.filter(F.col("run_id") != "__clock__")


def q_r4_incremental_recrawl(spark, sf):
    """Captured responses streamed in two batches; only pages whose
    validators changed are extracted and upserted."""
    prepare_session(spark)
    caps = fx.page_captures(spark, sf)
    src, out_pages, out_vals, ckpt = (monitor.scratch(spark, f"r4-{n}") for n in ("in", "pages", "validators", "checkpoint"))
    vals = materialize(fx.validators(spark, sf), "r4-stored")
    even = F.unix_seconds("fetched_at") % 2 == 0  # page ids are seconds after the base time
    for part in (caps.filter(even), caps.filter(~even)):
        part.write.mode("append").parquet(src)
        monitor.incremental_extract(monitor.file_stream(spark, src, CAPTURE_SCHEMA), vals, out_pages, out_vals, ckpt, STORE_BUCKETS)
    return KeyedTable(spark, out_pages, ["url"]).read().filter("outcome = 'extracted'").select("url", "title")


def q_r5_latest_item_state(spark, sf):
    """Latest state per work item from the streamed transition log."""
    prepare_session(spark)
    t = fx.work_item_transitions(spark, sf)
    mid = "2024-01-15 00:00:00"
    before = F.col("created_at") < F.lit(mid).cast("timestamp_ntz")
    src, out, ckpt = (monitor.scratch(spark, f"r5-{n}") for n in ("in", "out", "checkpoint"))
    for part in (t.filter(~before), t.filter(before)):  # the later half arrives first
        part.write.mode("append").parquet(src)
        monitor.keep_latest_state(monitor.file_stream(spark, src, t.schema), out, ckpt, buckets=STORE_BUCKETS)
    got = KeyedTable(spark, out, ["work_item_id"]).read()
    return got.select("work_item_id", "state")


STREAM_QUERIES = {
    "r1_dedup_events": q_r1_dedup_events,
    "r2_stage_throughput": q_r2_stage_throughput,
    "r2_sliding": q_r2_sliding,
    "r3_activity_sessions": q_r3_activity_sessions,
    "r4_incremental_recrawl": q_r4_incremental_recrawl,
    "r5_latest_item_state": q_r5_latest_item_state,
}


# ---------------------------------------------------------------------------
# Store operators
# ---------------------------------------------------------------------------


def q_s2_fetch(spark, sf):
    """Every discovered URL joined to its latest capture (404 if none)."""
    st = full_run(spark, sf)
    _sites, caps = crawl_inputs_cached(spark, sf)
    f = extract.fetch(st.discovery.discovered.select("run_id", "url"), extract.capture_index(caps))
    return f.select("run_id", "url", "status_code", "content_type")


_TIER_CATEGORY = ["llms_txt", "robots_hints", "sitemap", "no_information"]


def q_s3_site_list(spark, sf):
    """S3: a categorised site list (one category per discovery tier)
    written as JSON lines and read back with a category filter."""
    prepare_session(spark)
    cat = F.element_at(F.array(*[F.lit(c) for c in _TIER_CATEGORY]), (F.length("site_id") % 4 + 1).cast("int"))
    rows = read_table(spark, sf, "pages").select(fx.host_of("url").alias("site_id")).distinct().select(
        cat.alias("category"), F.initcap(F.translate(cat, "_", " ")).alias("category_name"),
        F.concat(F.lit("Sites with "), cat).alias("description"),
        "site_id", F.concat(F.lit("https://"), F.col("site_id")).alias("url"), F.lit("").alias("notes"),
    )
    path = monitor.scratch(spark, "site-list")
    sitelist.write_site_list(rows, path)
    return sitelist.read_site_list(spark, path, ["llms_txt", "robots_hints", "sitemap"]).select("category", "site_id", "url")


def _upserted(existing, batch, key, **options):
    """``existing`` as a stored keyed table after one upsert of ``batch``."""
    table = KeyedTable.create(existing, monitor.scratch(existing.sparkSession, "keyed"), key, STORE_BUCKETS)
    table.upsert(batch, **options)
    return table.read()


def q_s4_run_upsert(spark, sf):
    """Partial run updates (running runs get a score, then complete) and
    inserts applied as a keyed upsert; hosts and creation times stay."""
    prepare_session(spark)
    runs = fx.runs(spark, sf)
    live = runs.filter(F.col("status") == "running").select("run_id", "created_at")
    scored = live.select("run_id", F.lit("running").alias("status"), F.lit(0.25).alias("score"),
                         F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(1).alias("save"))
    done = live.select("run_id", F.lit("completed").alias("status"), F.lit(0.5).alias("score"),
                       F.expr("created_at + INTERVAL 1 DAY").alias("completed_at"), F.lit(2).alias("save"))
    new = (
        read_table(spark, sf, "events").select("event_type").distinct()
        .select(F.concat(F.lit("run-new-"), "event_type").alias("run_id"), F.lit("queued").alias("status"),
                F.to_timestamp(F.lit("2024-02-01 00:00:00")).cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("save"))
    )
    batch = done.unionByName(scored).unionByName(new, allowMissingColumns=True)
    out = _upserted(runs, batch, ["run_id"], order=["save"], mutable=["status", "score", "completed_at", "notes"])
    return out.select("run_id", "hostname", "status", "score", "created_at", "completed_at")


def q_s5_item_transitions(spark, sf):
    """Transition rows from a work-item state log; a save that does
    not change the state adds no row."""
    prepare_session(spark)
    s = fx.stage_log(spark, sf)
    wid = F.concat(F.lit("wi-"), F.col("event_id").cast("string"))
    final = F.when(F.col("failed"), "failed").otherwise("completed")
    rows = F.array(
        F.struct(F.lit("queued").alias("state"), F.col("started_at").alias("updated_at")),
        F.struct(F.lit("processing").alias("state"), F.expr("started_at + INTERVAL 1 MICROSECOND").alias("updated_at")),
        F.when(F.col("completed_at").isNotNull(), F.struct(final.alias("state"), F.col("completed_at").alias("updated_at"))),
        F.when(F.col("completed_at").isNotNull() & (F.col("event_id") % 7 == 0),
               F.struct(final.alias("state"), F.expr("completed_at + INTERVAL 1 SECOND").alias("updated_at"))),
    )
    log = s.select(wid.alias("id"), F.posexplode(rows).alias("seq", "r")).filter(F.col("r").isNotNull())
    log = log.select("id", "seq", "r.state", "r.updated_at")
    return store.changed_transitions(log, ("seq",))


def q_s6_insert_ignore(spark, sf):
    """Discovered URLs inserted once per run; returns the inserted."""
    prepare_session(spark)
    sp = fx.site_pages(spark, sf).select(fx.run_id_of("host").alias("run_id"), F.col("url_nf").alias("url"), "page_id")
    existing = sp.filter(F.col("page_id") % 2 == 0).select("run_id", "url")
    batch = sp.unionByName(sp.filter(F.col("page_id") % 5 == 0)).select("run_id", "url")
    _table, inserted = store.insert_ignore(existing, batch, ["run_id", "url"])
    return inserted


def _doc_pages(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("https://"), F.col("lang"), F.lit(".docs.example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("source"), F.lit(")")).alias("title"),
        "doc_id",
    )


def q_s7_page_upsert(spark, sf):
    """Page records upserted on (url): a second extraction replaces
    the title of every third document."""
    prepare_session(spark)
    p = _doc_pages(spark, sf)
    third = p.filter(F.col("doc_id") % 3 == 0)
    first = third.withColumn("title", F.concat(F.lit("v2: "), "title")).withColumn("save", F.lit(1))
    again = third.filter(F.col("doc_id") % 2 == 0).withColumn("title", F.concat(F.lit("a later v3: "), "title")).withColumn("save", F.lit(2))
    return _upserted(p, again.unionByName(first), ["url"], order=["save"]).select("url", "title")


def q_s8_validators(spark, sf):
    """Stored validators upserted with those of fresh 200 responses."""
    prepare_session(spark)
    caps = fx.page_captures(spark, sf).drop("body")
    caps = store.latest_by_key(caps, ["url"], "fetched_at").filter(F.col("status_code") == 200)
    batch = caps.select("url", header("etag").alias("etag"), header("last-modified").alias("last_modified"))
    return _upserted(fx.validators(spark, sf), batch, ["url"]).select("url", "etag", "last_modified")


def q_s9_artifact_replace(spark, sf):
    """A regenerated document replaces the stored one of its run."""
    prepare_session(spark)
    arts = fx.artifacts(spark, sf)
    num = F.substring_index("run_id", "-", -1).cast("long")
    batch = arts.filter(num % 2 == 0).withColumn("llms_txt", F.upper("llms_txt"))
    out = _upserted(arts, batch, ["run_id"])
    return out.select("run_id", F.octet_length("llms_txt").cast("long").alias("size_bytes"),
                      F.substring_index("llms_txt", "\n", 1).alias("first_line"))


def q_s10_event_log(spark, sf):
    """Stage events and per-page extraction events appended into one
    event log (metadata kept as JSON text)."""
    prepare_session(spark)
    columns = ["id", "run_id", "name", "system", "started_at", "completed_at", "metadata"]
    stage = fx.crawl_events(spark, sf).select(*columns)
    pages = cascade_result(spark, sf).events.select(*columns)
    path = monitor.scratch(spark, "event-log")
    for part in (stage, pages):  # appended, as two jobs would
        part.write.mode("append").parquet(path)
    log = spark.read.parquet(path)
    return log.select(
        "id", "run_id", "name", "system", "started_at", "completed_at", F.expr("try_parse_json(metadata) IS NOT NULL").alias("valid_json")
    )


def q_s11_read_pages(spark, sf):
    """Page records written clustered by run_id and read back
    with their provenance / confidence structs decoded."""
    st = full_run(spark, sf)
    path = monitor.scratch(spark, "pages-table")
    store.write_table(st.stages.pages.drop("url_key"), path, "run_id")
    p = spark.read.parquet(path)
    return p.select(
        "run_id", "url", "title",
        F.col("provenance.discovery").alias("discovery"),
        F.col("provenance.title").alias("title_source"),
        F.col("confidence.title").alias("title_confidence"),
    )


def q_l10_run_milestone(spark, sf):
    """Per completed run: pages indexed, duration and document bytes."""
    prepare_session(spark)
    runs = fx.runs(spark, sf).filter(F.col("status") == "completed")
    ev = fx.crawl_events(spark, sf)
    pages = ev.filter((F.col("system") == "extraction") & F.col("completed_at").isNotNull()).groupBy("run_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_pages_indexed")
    )
    arts = fx.artifacts(spark, sf).select("run_id", F.octet_length("llms_txt").cast("long").alias("llmstxt_size_bytes"))
    return runs.join(pages, "run_id", "left").join(arts, "run_id", "left").select(
        "run_id",
        F.coalesce("total_pages_indexed", F.lit(0).cast("long")).alias("total_pages_indexed"),
        audit.duration_seconds("created_at", "completed_at").alias("duration_seconds"),
        "llmstxt_size_bytes",
    )


def q_l11_span_records(spark, sf):
    """Stage span records with outcome and error."""
    ev = fx.crawl_events(spark, sf)
    return ev.select(
        "id", "run_id", "name", "system",
        F.get_json_object("metadata", "$.outcome").alias("outcome"),
        F.get_json_object("metadata", "$.error").alias("error"),
    )


STORE_QUERIES = {
    "s11_read_pages": q_s11_read_pages,
    "l10_run_milestone": q_l10_run_milestone,
    "l11_span_records": q_l11_span_records,
    "s2_fetch": q_s2_fetch,
    "s3_site_list": q_s3_site_list,
    "s4_run_upsert": q_s4_run_upsert,
    "s5_item_transitions": q_s5_item_transitions,
    "s6_insert_ignore": q_s6_insert_ignore,
    "s7_page_upsert": q_s7_page_upsert,
    "s8_validators": q_s8_validators,
    "s9_artifact_replace": q_s9_artifact_replace,
    "s10_event_log": q_s10_event_log,
}


# ---------------------------------------------------------------------------
# Documented capabilities beyond the pipeline
# ---------------------------------------------------------------------------


def q_x1_url_clusters(spark, sf):
    """Raw URL -> canonical URL, cluster id and size."""
    return canonical.url_clusters(full_run(spark, sf).stages.pages)


def q_x1_dedup_summary(spark, sf):
    """Raw vs canonical pages, dedup ratio and conflicting clusters."""
    return canonical.dedup_summary(full_run(spark, sf).stages.pages)


def q_x2_link_audit(spark, sf):
    """Every link of every page with the reason it is skipped."""
    h = _page_hrefs(spark, sf).withColumn("hostname", U.url_netloc("page_url"))
    return insights.link_audit(h, [".html", ".htm", ".txt", ".md", ""])


def q_x2_scan_skips(spark, sf):
    """Links of scanned pages beyond the depth or page bound."""
    scan = full_run(spark, sf).discovery.scan
    return insights.scan_skips(scan.visited, scan.edges, PipelineParams().spider.max_depth).withColumnRenamed("site", "run_id")


def q_x4_fallback_depth(spark, sf):
    """Strategies tried per run and the first that succeeded."""
    return insights.fallback_depth(full_run(spark, sf).discovery.strategy_log)


def q_x10_run_compare(spark, sf):
    """Canonical pages of a site against those of a later run, in which
    pages are gone, renamed or new by the length of their URL."""
    p = full_run(spark, sf).stages.canonical_pages.select(F.col("run_id").alias("site"), "url", "title", "description")
    k = F.length("url") % 3
    later = p.filter(k != 0).withColumn("title", F.when(k == 1, F.concat(F.lit("new "), F.coalesce("title", F.lit("")))).otherwise(F.col("title")))
    added = p.select("site").distinct().select(
        "site", F.concat(F.lit("https://new.example.org/"), "site").alias("url"), F.lit("n").alias("title"), F.lit(None).cast("string").alias("description"))
    return insights.run_compare(p, later.unionByName(added)).withColumnRenamed("site", "run_id")


def q_x3_robots_allowed(spark, sf):
    """Discovered URLs checked against each site's robots.txt rules."""
    st = full_run(spark, sf)
    sites, caps = crawl_inputs_cached(spark, sf)
    files = _INPUT_CACHE[(spark.sparkContext.applicationId, sf)][2]
    bases = site_bases(sites).withColumn("fetch_url", F.concat("base", F.lit("/robots.txt")))
    robots = fetch_bodies(bases, files, extract.capture_index(files)).filter(F.col("status_code") == 200)
    rules = insights.robots_rules(robots.select("run_id", "body"))
    return insights.robots_allowed(st.discovery.discovered.select("run_id", "url"), rules)


def q_x4_strategy_rates(spark, sf):
    """Attempts, successes and success rate per strategy."""
    return insights.strategy_rates(full_run(spark, sf).discovery.strategy_log)


def q_x4_latency_percentiles(spark, sf):
    """Latency of every attempt by strategy; the percentiles come from
    sketches stored per run, and are held against the exact ranks."""
    prepare_session(spark)
    strategy = F.element_at(F.array(*[F.lit(x) for x in ("direct_llms", "robots_hints", "sitemap", "spider")]), (F.col("event_id") % 4 + 1).cast("int"))
    attempts = read_table(spark, sf, "events").select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"), strategy.alias("strategy"), F.col("value").alias("latency_ms"))
    sketches = materialize(insights.latency_sketches(attempts), "latency-sketches")
    found = insights.latency_percentiles(sketches)
    errors = insights.latency_rank_errors(attempts, found)
    close = [(F.col(f"{name}_error") <= insights.LATENCY_RANK_ERROR).alias(f"{name}_close") for name in insights.LATENCY_RANKS]
    return found.join(errors, "strategy").select("strategy", "attempts", "fastest_ms", "slowest_ms", *close)


def q_x5_strategy_ranking(spark, sf):
    """Per-host strategy preference from past success."""
    sites, _ = crawl_inputs_cached(spark, sf)
    return insights.strategy_ranking(full_run(spark, sf).discovery.strategy_log, sites)


def q_x6_completeness(spark, sf):
    """Field completeness and low-score review flag per run."""
    st = full_run(spark, sf).stages
    return canonical.completeness(st.pages, st.scores)


def q_x7_conditional_savings(spark, sf):
    """Not-modified hit rate and bytes fetched per run."""
    return insights.conditional_savings(full_run(spark, sf).stages.outcomes)


def q_x8_hierarchical_sections(spark, sf):
    """Two-level section paths folded up when small."""
    return insights.hierarchical_sections(full_run(spark, sf).stages.canonical_pages)


def q_x9_markdown_pages(spark, sf):
    """Title and first paragraph of markdown pages (whole texts)."""
    prepare_session(spark)
    md = fx.markdown_captures(spark, sf)
    title, desc = insights.markdown_metadata(F.col("body"))
    return md.filter(header("content-type").contains("markdown")).select("url", title.alias("title"), desc.alias("description"))


def q_x10_document_diff(spark, sf):
    """Entries of the published llms.txt versus the generated one."""
    st = full_run(spark, sf)
    sites, _ = crawl_inputs_cached(spark, sf)
    c = st.discovery.candidates.filter(F.col("source") == "llms")
    published = c.filter(U.valid_http_url("raw_url")).select("run_id", U.normalize_http_url("raw_url").alias("url"))
    runs_with = published.select("run_id").distinct()
    generated = document.sectioned_entries(st.stages.canonical_pages, sites).join(runs_with, "run_id", "left_semi")
    return insights.entry_diff(published, generated.select("run_id", "url"))


def q_x11_recent_runs(spark, sf):
    """X11: runs of the last 24 hours versus older history."""
    return insights.run_recency(fx.runs(spark, sf), NOW)


def q_x12_stale_runs(spark, sf):
    """Active runs without an event in the last 6 hours."""
    return insights.stale_runs(fx.runs(spark, sf), fx.crawl_events(spark, sf), NOW)


def q_x13_fresh_importance(spark, sf):
    """Scan in-links weighted by the age of the page's Last-Modified."""
    st = full_run(spark, sf)
    _sites, caps = crawl_inputs_cached(spark, sf)
    ranked = linkgraph.rank_pages(st.discovery.scan)
    out = insights.fresh_importance(ranked, extract.capture_index(caps), NOW)
    return out.select(F.col("site").alias("run_id"), F.col("url_key").alias("url"), "fresh_score")


def q_x14_politeness_plan(spark, sf):
    """Per-host fetch offsets (10 ms apart) in discovery order."""
    return insights.politeness_plan(full_run(spark, sf).discovery.discovered)


INSIGHT_QUERIES = {
    "x1_url_clusters": q_x1_url_clusters,
    "x1_dedup_summary": q_x1_dedup_summary,
    "x2_link_audit": q_x2_link_audit,
    "x2_scan_skips": q_x2_scan_skips,
    "x3_robots_allowed": q_x3_robots_allowed,
    "x4_fallback_depth": q_x4_fallback_depth,
    "x10_run_compare": q_x10_run_compare,
    "x4_strategy_rates": q_x4_strategy_rates,
    "x4_latency_percentiles": q_x4_latency_percentiles,
    "x5_strategy_ranking": q_x5_strategy_ranking,
    "x6_completeness": q_x6_completeness,
    "x7_conditional_savings": q_x7_conditional_savings,
    "x8_hierarchical_sections": q_x8_hierarchical_sections,
    "x9_markdown_pages": q_x9_markdown_pages,
    "x10_document_diff": q_x10_document_diff,
    "x11_recent_runs": q_x11_recent_runs,
    "x12_stale_runs": q_x12_stale_runs,
    "x13_fresh_importance": q_x13_fresh_importance,
    "x14_politeness_plan": q_x14_politeness_plan,
}


def queries() -> dict[str, Query]:
    return {k: _as_long(v) for k, v in _registry().items()}


def _registry() -> dict[str, Query]:
    return {
        "site_index_captured": q_site_index_captured,
        "site_scores_captured": q_site_scores_captured,
        "site_index_tiered": q_site_index_tiered,
        **STAGE_QUERIES,
        **SCALAR_QUERIES,
        **AUDIT_QUERIES,
        **STREAM_QUERIES,
        **STORE_QUERIES,
        **INSIGHT_QUERIES,
    }
