"""G1-G7 on literal fake sites: link-filter and bounded-scan cases,
re-expressed as captured responses."""

from pyspark.sql import functions as F

from sitelens.config import SpiderBounds
from sitelens.operators import extract, linkgraph
from sitelens.sources.captures import captures_from_rows


def _html(*hrefs):
    return "<html><body>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body></html>"


def _scan(spark, pages: dict, seed: str, **bounds):
    caps = captures_from_rows(spark, [(u, 200, b) for u, b in pages.items()])
    index = extract.capture_index(caps)
    signals = extract.page_signals(caps, index)
    host = seed.split("/")[2]
    seeds = spark.createDataFrame([("s1", host, seed)], "site string, hostname string, seed_url string")
    return linkgraph.bfs_scan(seeds, index, signals, SpiderBounds(**bounds))


def _visited(scan):
    return {r.url_key: (r.depth, r.rank) for r in scan.visited.collect()}


def _links(spark, html, base="https://example.com/page", exts=(".html", ".htm", ".txt", ".md", "")):
    caps = captures_from_rows(spark, [(base, 200, html)])
    sig = extract.page_signals(caps)
    exp = sig.select("url_key", F.lit("s").alias("site"), F.lit("example.com").alias("hostname"))
    out = linkgraph.filtered_links(exp, sig, exts).orderBy("pos")
    return [r.dst for r in out.collect()]


def test_link_filter_domain_fragment_dedup(spark):
    html = _html("https://example.com/a", "https://other.com/b", "/c#section", "/c#other", "/a", "/d")
    assert _links(spark, html) == ["https://example.com/a", "https://example.com/c", "https://example.com/d"]


def test_link_filter_extensions(spark):
    html = _html("/s.css", "/app.js", "/i.png", "/page.html", "/plain")
    assert _links(spark, html) == ["https://example.com/page.html", "https://example.com/plain"]
    assert _links(spark, html, exts=(".html",)) == ["https://example.com/page.html"]


def test_link_filter_non_content_and_relative(spark):
    html = _html("/login", "/admin/dashboard", "/wp-admin", "/about", "../other", "sub/page")
    assert _links(spark, html) == [
        "https://example.com/about",
        "https://example.com/other",
        "https://example.com/sub/page",
    ]


def test_spider_reaches_linked_pages(spark):
    site = {
        "https://example.com/": _html("/about", "/docs"),
        "https://example.com/about": _html("/", "/docs"),
        "https://example.com/docs": _html("/about"),
    }
    v = _visited(_scan(spark, site, "https://example.com/", max_depth=2, max_scan_pages=10))
    assert set(v) == {"https://example.com/", "https://example.com/about", "https://example.com/docs"}
    assert v["https://example.com/about"] == (1, 1) and v["https://example.com/docs"] == (1, 2)


def test_spider_depth_limit(spark):
    site = {
        "https://example.com/": _html("/a"),
        "https://example.com/a": _html("/a/b"),
        "https://example.com/a/b": _html("/a/b/c"),
        "https://example.com/a/b/c": _html(),
    }
    v = _visited(_scan(spark, site, "https://example.com/", max_depth=2, max_scan_pages=10))
    assert "https://example.com/a/b" in v and "https://example.com/a/b/c" not in v


def test_spider_page_budget(spark):
    site = {"https://example.com/": _html("/a", "/b", "/c", "/d", "/e")}
    for p in "abcde":
        site[f"https://example.com/{p}"] = _html()
    v = _visited(_scan(spark, site, "https://example.com/", max_depth=3, max_scan_pages=3))
    assert set(v) == {"https://example.com/", "https://example.com/a", "https://example.com/b"}


def test_spider_inlinks_and_ranking(spark):
    site = {
        "https://example.com/": _html("/popular", "/other"),
        "https://example.com/popular": _html(),
        "https://example.com/other": _html("/popular"),
    }
    scan = _scan(spark, site, "https://example.com/")
    counts = {r.url_key: r.inlinks for r in linkgraph.inlink_counts(scan).collect()}
    assert counts["https://example.com/popular"] == 2 and counts["https://example.com/other"] == 1
    ranked = linkgraph.rank_pages(scan).orderBy("importance").collect()
    assert ranked[0].url_key == "https://example.com/popular"
    audit = {r.url_key: r for r in linkgraph.page_scan_audit(scan).collect()}
    assert audit["https://example.com/popular"].inlink_score == 1  # only the seed was scanned before it
    assert audit["https://example.com/"].links_found == 2
    summary = linkgraph.scan_summary(scan).first()
    assert summary.pages_scanned == 3 and summary.unique_links_found == 2


def test_spider_missing_target_and_unreachable_seed(spark):
    site = {"https://example.com/": _html("/exists", "/missing"), "https://example.com/exists": _html()}
    v = _visited(_scan(spark, site, "https://example.com/"))
    assert "https://example.com/missing" in v  # visited (404) but not expanded
    empty = _visited(_scan(spark, {"https://other.org/": _html()}, "https://example.com/"))
    assert list(empty) == ["https://example.com/"]
