"""Stand-in inputs derived from the driver tables.

The driver ships generic tables (``pages``, ``events``, ``documents``);
the jobs expect captured responses, site lists and audit logs.  Each
builder below only reshapes driver rows into the schema a job reads; it
does none of the job's work.  The same rules are written in DuckDB SQL in
``sitelens.plans.oracle`` so both engines see identical inputs.

Rules (``host`` = authority of a page URL, ``i`` = 1-based position of a
page inside its host by ``page_id``):

* captures: every page under its URL without fragment; status 500 when
  ``page_id % 10 = 0``, else 304 when ``page_id % 11 = 0``, else 200;
  ``etag = md5(html)``.
* discovery files by ``length(host) % 4``: 0 an ``llms.txt`` listing the
  host's pages, 1 a ``robots.txt`` with an ``LLMS:`` hint, a sitemap,
  Disallow / Allow rules and a second group shared by two agents,
  2 a ``/sitemap.xml`` (an index of odd / even child sitemaps plus a
  self reference when the host has more than 4 pages), 3 nothing: those
  hosts get a home page linking page 1, and page ``i`` gains links to
  pages ``2i``, ``2i+1`` and ``1``.
* ``documents`` become HTML whose head tags depend on ``doc_id % 8``.
* ``events`` become the audit log: one stage execution per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.tables import read_table

HOST_RE = r"^[^:/?#]+://([^/?#]*)"
BASE_TIME = "2024-01-01 00:00:00"
LAST_MODIFIED = "Mon, 01 Jan 2024 00:00:00 GMT"

# Fixed mapping of event types to pipeline stages.
EVENT_STAGE = (
    ("view", "discovery"),
    ("click", "extraction"),
    ("signup", "canonicalization"),
    ("purchase", "scoring"),
    ("error", "generation"),
)


def host_of(url: Column | str) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(c, HOST_RE, 1)


def run_id_of(host: Column | str) -> Column:
    c = F.col(host) if isinstance(host, str) else host
    return F.substring(F.sha2(c, 256), 1, 16)


def _ts(offset_seconds: Column) -> Column:
    return F.to_timestamp(F.lit(BASE_TIME)) + F.make_interval(secs=offset_seconds.cast("decimal(18,6)"))


_SITE_PAGES: dict = {}


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host, i (position of the page in its host, numbered
    without sorting a whole host in one task); the HTML is not carried along.
    Computed once per session."""
    from sitelens.functions.ordering import keyed_row_number

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SITE_PAGES:
        pages = read_table(spark, sf_dir, "pages").select("page_id", "url", host_of("url").alias("host"))
        numbered = keyed_row_number(pages, ["host"], ["page_id"], "i")
        _SITE_PAGES[key] = (
            numbered.withColumn("i", F.col("i").cast("int"))
            .withColumn("url_nf", F.substring_index("url", "#", 1))
            .withColumn("tier", F.length("host") % 4)
            .select("page_id", "url", "host", "url_nf", "i", "tier")
        )
    return _SITE_PAGES[key]


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site (run) per host: run_id, target_url, hostname, created_at."""
    hosts = read_table(spark, sf_dir, "pages").select(host_of("url").alias("hostname")).distinct()
    return hosts.select(
        run_id_of("hostname").alias("run_id"),
        F.concat(F.lit("https://"), F.col("hostname")).alias("target_url"),
        "hostname",
        F.to_timestamp(F.lit(BASE_TIME)).alias("created_at"),
    )


def _headers(content_type: str | Column, etag: Column) -> Column:
    """Response headers, spelled as servers send them."""
    return F.create_map(
        F.lit("Content-Type"), F.lit(content_type),
        F.lit("ETag"), etag,
        F.lit("Last-Modified"), F.lit(LAST_MODIFIED),
    )


def page_captures(spark: SparkSession, sf_dir: str, link_graph: bool = False) -> DataFrame:
    """Captured responses of the driver pages (url, status, headers, body).

    With ``link_graph`` the pages of hosts without discovery files carry
    the extra navigation links described in the module docstring.
    """
    pages = read_table(spark, sf_dir, "pages").withColumn("url_nf", F.substring_index("url", "#", 1))
    body = F.col("html")
    if link_graph:
        sp = site_pages(spark, sf_dir)
        targets = sp.select(
            F.col("host").alias("t_host"), F.col("i").alias("t_i"), F.col("url_nf").alias("t_url")
        )
        nav = (
            sp.filter(F.col("tier") == 3)
            .select("page_id", "host", F.posexplode(F.array(F.col("i") * 2, F.col("i") * 2 + 1, F.lit(1))).alias("pos", "want_i"))
            .join(targets, (F.col("host") == F.col("t_host")) & (F.col("want_i") == F.col("t_i")), "inner")
            .groupBy("page_id")
            .agg(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("pos", "t_url"))),
                        lambda x: F.concat(F.lit('<a href="'), x["t_url"], F.lit('">next</a>')),
                    ),
                    "",
                ).alias("nav")
            )
        )
        # Only pages of hosts without discovery files meet their links.
        linked = F.length(host_of("url")) % 4 == 3
        pages = pages.filter(linked).join(nav, "page_id", "left").unionByName(
            pages.filter(~linked).withColumn("nav", F.lit(None).cast("string"))
        )
        body = F.when(
            F.col("nav").isNotNull(), F.concat(F.col("html"), F.lit("<nav>"), F.col("nav"), F.lit("</nav>"))
        ).otherwise(F.col("html"))
    status = (
        F.when(F.col("page_id") % 10 == 0, F.lit(500))
        .when(F.col("page_id") % 11 == 0, F.lit(304))
        .otherwise(F.lit(200))
    )
    return pages.select(
        F.col("url_nf").alias("url"),
        status.alias("status_code"),
        _headers("text/html; charset=utf-8", F.md5(F.col("html"))).alias("headers"),
        body.alias("body"),
        _ts(F.col("page_id")).alias("fetched_at"),
    )


def _xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _urlset(locs: Column) -> Column:
    """sitemaps.org urlset document from an array of URLs."""
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
        F.array_join(F.transform(locs, lambda u: F.concat(F.lit("  <url><loc>"), _xml_text(u), F.lit("</loc></url>\n"))), ""),
        F.lit("</urlset>\n"),
    )


def _sitemap_index(children: Column) -> Column:
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
        F.array_join(
            F.transform(children, lambda u: F.concat(F.lit("  <sitemap><loc>"), _xml_text(u), F.lit("</loc></sitemap>\n"))), ""
        ),
        F.lit("</sitemapindex>\n"),
    )


def discovery_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured discovery files and home pages per host (see module doc)."""
    sp = site_pages(spark, sf_dir)

    def ordered(cond: Column | None, value: Column) -> Column:
        item = F.struct(F.col("page_id"), value.alias("v"))
        coll = F.collect_list(F.when(cond, item) if cond is not None else item)
        return F.transform(F.array_sort(coll), lambda x: x["v"])

    rel = F.regexp_replace(F.col("url_nf"), HOST_RE, "")
    llms_line = F.concat(
        F.lit("- [Page "), F.col("i").cast("string"), F.lit("]("),
        F.when(F.col("i") % 2 == 1, F.col("url_nf")).otherwise(rel),
        F.lit("): about page "), F.col("i").cast("string"),
    )
    per_host = sp.groupBy("host", "tier").agg(
        F.count(F.lit(1)).alias("n"),
        ordered(None, F.col("url_nf")).alias("all_urls"),
        ordered(F.col("i") % 2 == 1, F.col("url_nf")).alias("odd_urls"),
        ordered(F.col("i") % 2 == 0, F.col("url_nf")).alias("even_urls"),
        ordered(None, llms_line).alias("llms_lines"),
        F.min(F.when(F.col("i") == 1, F.col("url_nf"))).alias("first_url"),
    )
    base = F.concat(F.lit("https://"), F.col("host"))
    llms = per_host.filter(F.col("tier") == 0).select(
        F.concat(base, F.lit("/llms.txt")).alias("url"),
        F.lit("text/plain").alias("ctype"),
        F.concat(
            F.lit("# "), F.col("host"), F.lit("\n\n> Pages of "), F.col("host"), F.lit("\n\n## Pages\n\n"),
            F.array_join(F.col("llms_lines"), "\n"),
            F.lit("\n- [Contact](mailto:info@"), F.col("host"), F.lit(")\n"),
        ).alias("body"),
    )
    robots = per_host.filter(F.col("tier") == 1).select(
        F.concat(base, F.lit("/robots.txt")).alias("url"),
        F.lit("text/plain").alias("ctype"),
        F.concat(
            F.lit("User-agent: *\nDisallow: /admin\nLLMS: /llms-full.txt\n  Sitemap: "),
            base, F.lit("/ignored.xml\nSitemap: "), base, F.lit("/sitemap-pages.xml\nDisallow: /de/\nAllow: /de/1\n\nUser-agent: other\nUser-agent: *\nDisallow: /*7$\n"),
        ).alias("body"),
    )
    robots_map = per_host.filter(F.col("tier") == 1).select(
        F.concat(base, F.lit("/sitemap-pages.xml")).alias("url"),
        F.lit("application/xml").alias("ctype"),
        _urlset(F.col("all_urls")).alias("body"),
    )
    t2 = per_host.filter(F.col("tier") == 2)
    big = F.col("n") > 4
    sitemap_root = t2.select(
        F.concat(base, F.lit("/sitemap.xml")).alias("url"),
        F.lit("application/xml").alias("ctype"),
        F.when(
            big,
            _sitemap_index(
                F.array(
                    F.concat(base, F.lit("/sitemap-odd.xml")),
                    F.concat(base, F.lit("/sitemap-even.xml")),
                    F.concat(base, F.lit("/sitemap.xml")),
                )
            ),
        ).otherwise(_urlset(F.col("all_urls"))).alias("body"),
    )
    odd = t2.filter(big).select(
        F.concat(base, F.lit("/sitemap-odd.xml")).alias("url"),
        F.lit("application/xml").alias("ctype"),
        _urlset(F.col("odd_urls")).alias("body"),
    )
    even = t2.filter(big).select(
        F.concat(base, F.lit("/sitemap-even.xml")).alias("url"),
        F.lit("application/xml").alias("ctype"),
        _urlset(F.col("even_urls")).alias("body"),
    )
    home = per_host.filter(F.col("tier") == 3).select(
        base.alias("url"),
        F.lit("text/html; charset=utf-8").alias("ctype"),
        F.concat(
            F.lit("<!DOCTYPE html><html><head><title>"), F.col("host"),
            F.lit("</title></head><body><a href=\""), F.col("first_url"), F.lit("\">start</a></body></html>"),
        ).alias("body"),
    )
    files = llms.unionByName(robots).unionByName(robots_map).unionByName(sitemap_root)
    files = files.unionByName(odd).unionByName(even).unionByName(home)
    return files.select(
        "url",
        F.lit(200).alias("status_code"),
        _headers(F.col("ctype"), F.md5(F.col("body"))).alias("headers"),
        "body",
        F.to_timestamp(F.lit(BASE_TIME)).alias("fetched_at"),
    )


def deep_sitemap_captures(spark: SparkSession, sf_dir: str, levels: int = 8) -> DataFrame:
    """Sitemap indexes nested ``levels`` deep per host: ``/deep-<k>.xml``
    lists ``/deep-<k+1>.xml`` (but for the last) and ``/set-<k>.xml``, which
    holds the pages with ``(i - 1) % levels = k`` in order."""
    sp = site_pages(spark, sf_dir).select("host", "i", "url_nf")
    base = F.concat(F.lit("https://"), F.col("host"))
    sets = sp.groupBy("host", ((F.col("i") - 1) % levels).alias("k")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "url_nf"))), lambda x: x["url_nf"]).alias("locs")
    ).select(F.concat(base, F.lit("/set-"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), _urlset(F.col("locs")).alias("body"))
    k = F.col("k")
    own = F.concat(base, F.lit("/set-"), k.cast("string"), F.lit(".xml"))
    child = F.concat(base, F.lit("/deep-"), (k + 1).cast("string"), F.lit(".xml"))
    index = sp.select("host").distinct().select("host", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("k")).select(
        F.concat(base, F.lit("/deep-"), k.cast("string"), F.lit(".xml")).alias("url"),
        _sitemap_index(F.when(k < levels - 1, F.array(child, own)).otherwise(F.array(own))).alias("body"),
    )
    return sets.unionByName(index).select(
        "url", F.lit(200).alias("status_code"), _headers(F.lit("application/xml"), F.md5("body")).alias("headers"), "body",
        F.to_timestamp(F.lit(BASE_TIME)).alias("fetched_at"),
    )


def mutual_sitemap_captures(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """Sitemap indexes that all list each other, per host: ``/mutual-<k>.xml``
    lists every ``/mutual-<j>.xml`` (itself too) and then ``/set-<k>.xml``,
    which holds the pages with ``(i - 1) % n = k`` in order."""
    sets = deep_sitemap_captures(spark, sf_dir, n).filter(F.col("url").contains("/set-"))
    base = F.concat(F.lit("https://"), F.col("host"))
    named = lambda name, k: F.concat(base, F.lit(f"/{name}-"), k.cast("string"), F.lit(".xml"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: named("mutual", j))
    hosts = site_pages(spark, sf_dir).select("host").distinct()
    index = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        named("mutual", F.col("k")).alias("url"), _sitemap_index(F.concat(every, F.array(named("set", F.col("k"))))).alias("body")
    )
    return sets.unionByName(index.select(
        "url", F.lit(200).alias("status_code"), _headers(F.lit("application/xml"), F.md5("body")).alias("headers"), "body",
        F.to_timestamp(F.lit(BASE_TIME)).alias("fetched_at"),
    ))


def crawl_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything a crawl of the driver hosts would have fetched."""
    return page_captures(spark, sf_dir, link_graph=True).unionByName(discovery_captures(spark, sf_dir))


# ---------------------------------------------------------------------------
# Documents as HTML pages (extraction cascade)
# ---------------------------------------------------------------------------
def _html_escape(c: Column) -> Column:
    amp = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def cascade_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an HTML page whose head tags depend on
    ``doc_id % 8``: 0 title + meta description, 1 og tags, 2 twitter tags
    (property=), 3 JSON-LD (a numeric headline object, then an Article),
    4 title only, 5 description only, 6 nothing, 7 title + an empty first
    meta description + og:description.  Every body carries decoy tags.
    Title text: 'Document <id> (<source>)'; description: the whole text.
    """
    d = read_table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("source"), F.lit(")"))
    t, x = _html_escape(title), _html_escape(F.col("text"))
    k = F.col("doc_id") % 8

    def meta(attr: str, key: str, val: Column) -> Column:
        return F.concat(F.lit(f'<meta {attr}="{key}" content="'), val, F.lit('">'))

    ld = F.concat(
        F.lit('[{"@type":"WebSite","headline":1},'),
        F.to_json(
            F.struct(
                F.lit("https://schema.org").alias("@context"),
                F.lit("Article").alias("@type"),
                title.alias("headline"),
                F.col("text").alias("description"),
            )
        ),
        F.lit("]"),
    )
    ld = F.replace(ld, F.lit("</"), F.lit("<\\/"))
    tag_title = F.concat(F.lit("<title>"), t, F.lit("</title>"))
    head = (
        F.when(k == 0, F.concat(tag_title, meta("name", "description", x)))
        .when(k == 1, F.concat(meta("property", "og:title", t), meta("property", "og:description", x)))
        .when(k == 2, F.concat(meta("property", "twitter:title", t), meta("property", "twitter:description", x)))
        .when(k == 3, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")))
        .when(k == 4, tag_title)
        .when(k == 5, meta("name", "description", x))
        .when(k == 6, F.lit(""))
        .otherwise(
            F.concat(tag_title, meta("name", "description", F.lit("")), meta("name", "description", x),
                     meta("property", "og:description", x))
        )
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8">'), head,
        F.lit("</head><body><title>decoy</title><meta name=\"description\" content=\"decoy\"><h1>"), t,
        F.lit("</h1><p>"), x, F.lit("</p></body></html>"),
    )
    url = F.concat(F.lit("https://"), F.col("lang"), F.lit(".docs.example.org/"), F.col("doc_id").cast("string"))
    return d.select(
        url.alias("url"),
        F.lit(200).alias("status_code"),
        _headers("text/html; charset=utf-8", F.md5(F.col("text"))).alias("headers"),
        html.alias("body"),
        _ts(F.col("doc_id")).alias("fetched_at"),
    )


def cascade_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per document language host."""
    hosts = read_table(spark, sf_dir, "documents").select(
        F.concat(F.col("lang"), F.lit(".docs.example.org")).alias("hostname")
    ).distinct()
    return hosts.select(
        run_id_of("hostname").alias("run_id"),
        F.concat(F.lit("https://"), F.col("hostname")).alias("target_url"),
        "hostname",
        F.to_timestamp(F.lit(BASE_TIME)).alias("created_at"),
    )


# ---------------------------------------------------------------------------
# Audit trail derived from ``events`` (one stage execution per event)
# ---------------------------------------------------------------------------
def _stage_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for etype, stage in reversed(EVENT_STAGE):
        out = F.when(event_type == etype, F.lit(stage)).otherwise(out)
    return out


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, event_id, stage, started_at, completed_at (NULL when the
    execution is still open: ``event_id % 50 = 0``), failed (``k < 5``),
    value, k.  Times are TIMESTAMP_NTZ."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    done = F.expr("ts + make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))")
    return e.select(
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id"),
        "event_id",
        _stage_of(F.col("event_type")).alias("stage"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 50 == 0, F.lit(None)).otherwise(done).alias("completed_at"),
        (k < 5).alias("failed"),
        "value",
        k.alias("k"),
        "user_id",
    )


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events: id, run_id, name, system, started_at, completed_at,
    metadata (JSON text)."""
    s = stage_log(spark, sf_dir)
    meta = (
        F.when(F.col("completed_at").isNull(), F.lit("{}"))
        .when(F.col("failed"), F.concat(F.lit('{"error": "stage failed: k='), F.col("k").cast("string"), F.lit('", "outcome": "failure"}')))
        .otherwise(F.lit('{"outcome": "success"}'))
    )
    return s.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("id"),
        "run_id",
        F.concat(F.lit("stage."), F.col("stage")).alias("name"),
        F.col("stage").alias("system"),
        "started_at",
        "completed_at",
        meta.alias("metadata"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per user: running when ``user_id % 17 = 0``, failed when
    more than 3 of its stage executions failed, else completed."""
    s = stage_log(spark, sf_dir)
    agg = s.groupBy("run_id", "user_id").agg(
        F.min("started_at").alias("first"),
        F.max(F.coalesce("completed_at", "started_at")).alias("last"),
        F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failures"),
        F.avg("value").alias("avg_value"),
    )
    status = (
        F.when(F.col("user_id") % 17 == 0, F.lit("running"))
        .when(F.col("failures") > 3, F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    host = F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com"))
    return agg.select(
        "run_id",
        host.alias("hostname"),
        F.concat(F.lit("https://"), host).alias("target_url"),
        status.alias("status"),
        F.when(status == "completed", F.round(F.col("avg_value") / 500, 4)).alias("score"),
        F.expr("first - INTERVAL 1 SECOND").alias("created_at"),
        F.when(status != "running", F.col("last")).alias("completed_at"),
        F.when(status == "failed", F.lit('{"processing_error": "stage failed"}')).otherwise(F.lit("{}")).alias("notes"),
    )


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per stage execution plus the run's initial queued item."""
    s = stage_log(spark, sf_dir)
    state = (
        F.when(F.col("completed_at").isNull(), F.lit("processing"))
        .when(F.col("failed"), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    items = s.select(
        F.concat(F.lit("wi-"), F.col("event_id").cast("string")).alias("id"),
        "run_id",
        "stage",
        state.alias("state"),
        F.concat(F.lit("https://site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("url"),
        F.lit(1).alias("attempt_count"),
        F.when(state == "failed", F.concat(F.lit("stage failed: k="), F.col("k").cast("string"))).alias("last_error"),
        F.lit(100).alias("priority"),
        F.col("started_at").alias("created_at"),
        F.coalesce("completed_at", "started_at").alias("updated_at"),
    )
    r = runs(spark, sf_dir)
    queued = r.select(
        F.concat(F.lit("wi-q-"), F.substring_index("run_id", "-", -1)).alias("id"),
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
    return items.unionByName(queued)


def work_item_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only transition log (work_item_id, from_state, to_state,
    created_at, seq = position in the item's log).  ``event_id % 997 = 0``
    adds an illegal re-open."""
    s = stage_log(spark, sf_dir)
    wid = F.concat(F.lit("wi-"), F.col("event_id").cast("string"))
    final = F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("completed"))
    null = F.lit(None).cast("string")
    rows = F.array(
        F.struct(null.alias("from_state"), F.lit("queued").alias("to_state"), F.col("started_at").alias("at")),
        F.struct(F.lit("queued").alias("from_state"), F.lit("processing").alias("to_state"), F.col("started_at").alias("at")),
        F.when(
            F.col("completed_at").isNotNull(),
            F.struct(F.lit("processing").alias("from_state"), final.alias("to_state"), F.col("completed_at").alias("at")),
        ),
        F.when(
            F.col("completed_at").isNotNull() & (F.col("event_id") % 997 == 0),
            F.struct(final.alias("from_state"), F.lit("processing").alias("to_state"), F.expr("completed_at + INTERVAL 1 SECOND").alias("at")),
        ),
    )
    t = s.select(wid.alias("work_item_id"), F.posexplode(rows).alias("seq", "t")).filter(F.col("t").isNotNull())
    t = t.select("work_item_id", "t.from_state", "t.to_state", F.col("t.at").alias("created_at"), "seq")
    q = runs(spark, sf_dir).select(
        F.concat(F.lit("wi-q-"), F.substring_index("run_id", "-", -1)).alias("work_item_id"),
        null.alias("from_state"), F.lit("queued").alias("to_state"), "created_at", F.lit(0).alias("seq"),
    )
    return t.unionByName(q)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per completed run listing its stage events."""
    s = stage_log(spark, sf_dir)
    r = runs(spark, sf_dir).filter(F.col("status") == "completed").select(
        "run_id", "hostname", F.col("completed_at").alias("run_completed_at")
    )
    lines = s.join(r, "run_id").select(
        "run_id", "hostname", "run_completed_at", "event_id",
        F.concat(F.lit("- ["), F.col("stage"), F.lit(" "), F.col("event_id").cast("string"), F.lit("](https://"),
                 F.col("hostname"), F.lit("/e/"), F.col("event_id").cast("string"), F.lit(")")).alias("line"),
    )
    doc = lines.groupBy("run_id", "hostname", "run_completed_at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    return doc.select(
        "run_id",
        F.concat(F.lit("# "), F.col("hostname"), F.lit("\n\n> Activity of "), F.col("hostname"), F.lit("\n\n## Events\n\n"),
                 F.col("body"), F.lit("\n")).alias("llms_txt"),
        F.col("run_completed_at").alias("generated_at"),
    )


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored validators (one per URL, from its latest page): current ETag
    for ``page_id % 3 = 0``, a stale one for ``% 3 = 1``, none otherwise."""
    sp = site_pages(spark, sf_dir)
    latest = sp.groupBy("url_nf").agg(F.max("page_id").alias("page_id"))
    sp = sp.join(latest, ["url_nf", "page_id"], "left_semi")
    sp = sp.join(read_table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("md5")), "page_id")
    etag = F.when(F.col("page_id") % 3 == 0, F.col("md5")).otherwise(
        F.concat(F.lit("stale-"), F.col("page_id").cast("string"))
    )
    return sp.filter(F.col("page_id") % 3 != 2).select(
        F.col("url_nf").alias("url"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified")
    )


def markdown_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents served as markdown: '# <title>' + blank line + the text."""
    d = read_table(spark, sf_dir, "documents")
    title = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" ("), F.col("source"), F.lit(")"))
    url = F.concat(F.lit("https://"), F.col("lang"), F.lit(".docs.example.org/md/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(
        url.alias("url"),
        F.lit(200).alias("status_code"),
        _headers("text/markdown; charset=utf-8", F.md5(F.col("text"))).alias("headers"),
        F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("body"),
        _ts(F.col("doc_id")).alias("fetched_at"),
    )
