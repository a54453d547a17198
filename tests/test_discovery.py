"""D1-D10 on literal site captures: llms.txt, robots hints, sitemap
indexes (cycle, malformed, prefixed), tier gating and first source."""

import pytest

from sitelens.config import SpiderBounds
from sitelens.operators import discovery, extract, linkgraph
from sitelens.session import materialize
from sitelens.sources.captures import captures_from_rows, sites_from_urls

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _urlset(*locs, ns=NS):
    return f"<urlset {ns}>" + "".join(f"<url><loc> {u} </loc></url>" for u in locs) + "</urlset>"


def _index(*locs):
    return f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in locs) + "</sitemapindex>"


def _discover(spark, rows, targets):
    caps = captures_from_rows(spark, rows)
    index = extract.capture_index(caps)
    res = discovery.discover(sites_from_urls(spark, targets), caps, index, SpiderBounds())
    found = {}
    for r in res.discovered.orderBy("run_id", "ord").collect():
        found.setdefault(r.run_id, []).append((r.url, r.provenance))
    return found, res


def test_llms_and_robots_tiers(spark):
    rows = [
        ("https://a.com/llms.txt", 200, "# A\n- [Doc](/docs) and [x](/ignored)\nno link\n- [Mail](mailto:x@a.com)\n- [Abs](https://a.com/abs)"),
        ("https://a.com/robots.txt", 200, "User-agent: *\nLLMS: /llms-full.txt\n  sitemap: https://a.com/ignored.xml\nSitemap: https://a.com/sm.xml"),
        ("https://a.com/sm.xml", 200, _urlset("https://a.com/s1", "https://a.com/docs")),
    ]
    found, res = _discover(spark, rows, ["https://a.com"])
    assert found["a.com"] == [
        ("https://a.com/docs", "llms"),
        ("https://a.com/abs", "llms"),
        ("https://a.com/llms-full.txt", "robots"),
        ("https://a.com/s1", "sitemap"),
    ]
    assert [r.url for r in res.rejects.collect()] == ["mailto:x@a.com"]


def test_sitemap_index_cycle_malformed_prefixed(spark):
    rows = [
        ("https://b.com/sitemap.xml", 200, _index("https://b.com/child.xml", "https://b.com/sitemap.xml", "https://b.com/bad.xml", "https://b.com/pre.xml")),
        ("https://b.com/child.xml", 200, _urlset("https://b.com/c1", "https://b.com/c2")),
        ("https://b.com/bad.xml", 200, "<urlset><url><loc>https://b.com/broken"),
        ("https://b.com/pre.xml", 200, '<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"><sm:url><sm:loc>https://b.com/p1</sm:loc></sm:url></sm:urlset>'),
        ("https://c.com/sitemap.xml", 200, _urlset("https://c.com/x", ns="")),
    ]
    found, res = _discover(spark, rows, ["https://b.com", "https://c.com"])
    assert found["b.com"] == [("https://b.com/c1", "sitemap"), ("https://b.com/c2", "sitemap"), ("https://b.com/p1", "sitemap")]
    # no namespace: not a sitemap, so the site falls through to the spider
    assert found["c.com"] == [("https://c.com/", "crawl")]
    log = {(r.run_id, r.strategy): r for r in res.strategy_log.collect()}
    assert log[("c.com", "direct_llms")].status_code == 404 and log[("c.com", "spider")].success


def test_sitemaps_nested_deeper_than_any_cap(spark):
    rows = [(f"https://n.com/{'sitemap' if k == 0 else f's{k}'}.xml", 200, _index(f"https://n.com/s{k + 1}.xml")) for k in range(9)]
    rows.append(("https://n.com/s9.xml", 200, _urlset("https://n.com/deep")))
    found, _res = _discover(spark, rows, ["https://n.com"])
    assert found["n.com"] == [("https://n.com/deep", "sitemap")]


def _expand(spark, rows, root):
    caps = captures_from_rows(spark, rows)
    roots = spark.createDataFrame([("r", 3, [], root)], "run_id string, tier int, key array<long>, sitemap_url string")
    found = discovery.expand_sitemaps(roots, caps, extract.capture_index(caps)).collect()
    return [r.raw_url for r in sorted(found, key=lambda r: r.ord["key"])]


def _walk(pages, url, seen):
    """Depth-first walk that visits every sitemap once: children first, then the own URLs."""
    seen.add(url)
    children, own = pages[url]
    return [u for c in children if c not in seen for u in _walk(pages, c, seen)] + own


def _as_rows(pages):
    body = lambda children, own: _index(*children).replace("</sitemapindex>", "") + "".join(f"<url><loc>{u}</loc></url>" for u in own) + "</sitemapindex>"
    return [(u, 200, body(*p)) for u, p in pages.items()]


def test_mutual_sitemaps_are_read_once(spark):
    names = [f"https://m.com/s{i}.xml" for i in range(30)]
    pages = {u: (names, [f"https://m.com/p{i}"]) for i, u in enumerate(names)}
    assert _expand(spark, _as_rows(pages), names[0]) == _walk(pages, names[0], set())


def test_twenty_levels_of_diamonds(spark):
    pages = {}
    for k in range(20):
        low = [f"https://m.com/{s}{k + 1}.xml" for s in "ab"]
        for s in "ab":
            pages[f"https://m.com/{s}{k}.xml"] = (low[:: 1 if s == "a" else -1], [f"https://m.com/{s}{k}"])
    pages |= {f"https://m.com/{s}20.xml": ([], [f"https://m.com/{s}20"]) for s in "ab"}
    assert _expand(spark, _as_rows(pages), "https://m.com/a0.xml") == _walk(pages, "https://m.com/a0.xml", set())


def test_random_sitemap_graphs_follow_the_walk(spark):
    import random

    for seed in (1, 2):
        rnd = random.Random(seed)
        names = [f"https://m.com/s{i}.xml" for i in range(9)]
        pages = {u: (rnd.sample(names, rnd.randrange(5)), [f"https://m.com/p{i}"]) for i, u in enumerate(names)}
        assert _expand(spark, _as_rows(pages), names[0]) == _walk(pages, names[0], set())


def test_gating_skips_later_tiers(spark):
    rows = [
        ("https://d.com/llms.txt", 200, "- [A](/a)"),
        ("https://d.com/sitemap.xml", 200, _urlset("https://d.com/never")),
        ("https://d.com/", 200, '<a href="/never2">x</a>'),
    ]
    found, res = _discover(spark, rows, ["https://d.com"])
    assert found["d.com"] == [("https://d.com/a", "llms")]
    assert sorted(r.strategy for r in res.strategy_log.collect()) == ["direct_llms", "robots_hints"]


@pytest.fixture(scope="module")
def many_links(spark, n=300):
    sites = spark.createDataFrame([("r1", "https://a.com", "a.com"), ("r2", "https://b.com", "b.com")], "run_id string, target_url string, hostname string")
    lines = "\n".join(f"- [p{i}](/p{i})" for i in range(n))
    html = "".join(f'<a href="/p{i}">p</a>' for i in range(n))
    rows = [("https://a.com/llms.txt", 200, lines), ("https://b.com", 200, html)] + [(f"https://b.com/p{i}", 200, f"<title>{i}</title>") for i in range(n)]
    caps = captures_from_rows(spark, rows)
    index = extract.capture_index(caps)
    return index, discovery.discover(sites, caps, index)


def test_small_tables_of_much_work_are_spread(many_links):
    """A file of links is no single task, nor are the URLs found in it."""
    _, found = many_links
    urls = found.discovered.filter("run_id = 'r1'")
    assert urls.count() == 300 and len(found.discovered.inputFiles()) > 1
    assert len([f for f in found.candidates.inputFiles() if "cand-llms" in f]) > 1


def test_strategy_log_is_not_computed_again(many_links):
    _, found = many_links
    assert found.strategy_log.inputFiles() and all("strategy-log" in f for f in found.strategy_log.inputFiles())
    assert {(r.run_id, r.strategy, r.success, r.urls_found) for r in found.strategy_log.collect()} >= {("r1", "direct_llms", True, 300), ("r2", "spider", True, 50)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_a_row_per_page_are_not_broadcast(many_links):
    index, found = many_links
    index = materialize(index, "test-index")
    fetched = extract.fetch(found.discovered.select("run_id", "url"), index)
    pages = found.signals.selectExpr("'r2' AS site", "'b.com' AS hostname", "url_key")
    links = linkgraph.filtered_links(pages, found.signals, [""])
    for df in (fetched, links):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)
