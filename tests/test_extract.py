"""E1-E8 cascades on literal HTML (reference worker / page-indexer cases
plus the JSON-LD and meta edge cases it leaves untested)."""

import os

import pytest
from pyspark.sql import functions as F

from sitelens.functions.html import jsonld_string, parse_signals
from sitelens.operators import extract
from sitelens.sources.captures import captures_from_rows


def _pages(spark, html_by_url: dict):
    caps = captures_from_rows(spark, [(u, 200, h) for u, h in html_by_url.items()])
    sig = extract.page_signals(caps)
    return {r.url_key: r for r in extract.apply_cascades(sig).collect()}


def test_head_values_beat_body_decoys(spark):
    html = (
        "<html><head><title> Real Title </title><meta name='description' content='Real description'></head>"
        "<body><title>Decoy</title><meta name='description' content='Decoy'></body></html>"
    )
    r = _pages(spark, {"https://e.com/a": html})["https://e.com/a"]
    assert (r.title_value, r.title_source, r.title_confidence) == ("Real Title", "title", 1.0)
    assert (r.description_value, r.description_source, r.description_confidence) == ("Real description", "meta:description", 1.0)


def test_twitter_fallback_uses_property(spark):
    html = (
        '<html><head><meta property="twitter:title" content="TW"><meta property="twitter:description" content="TD">'
        '<meta name="twitter:title" content="by-name"></head></html>'
    )
    r = _pages(spark, {"https://e.com/t": html})["https://e.com/t"]
    assert (r.title_value, r.title_source, r.title_confidence) == ("TW", "twitter:title", 0.75)
    assert (r.description_value, r.description_source) == ("TD", "twitter:description")


def test_jsonld_rules(spark):
    cases = [
        (['{"headline": "H", "description": "D"}'], "H"),
        (['[{"headline": 1}, {"headline": " L "}]'], "L"),
        (["{bad json", '{"headline": "after"}'], "after"),
        (['{"@graph": [{"headline": "deep"}]}'], None),
        (['"just a string"'], None),
        (['{"headline": null}', '{"headline": "n"}'], "n"),
        (['{"headline": ""}', '{"headline": "later"}'], ""),
        (["[" * 200_000 + "]" * 200_000, '{"headline": "ok"}'], "ok"),
        (['{"headline": "a", "headline": "b"}'], "b"),
        ([], None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, scripts array<string>")
    got = {r.i: r.v for r in df.select("i", jsonld_string("scripts", "headline").alias("v")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_hostile_pages_do_not_end_the_job(spark):
    pages = {
        "https://e.com/1": "<head><title>a&#xD800;b</title><meta name='description' content='&#xDFFF;x'></head>",
        "https://e.com/2": '<head><script type="application/ld+json">{"headline": "\\ud800"}</script></head>',
        "https://e.com/3": '<head><script type="application/ld+json">' + "[" * 50_000 + "</script><title>T</title></head>",
    }
    got = _pages(spark, pages)
    assert got["https://e.com/1"].title_value == "a\ufffdb"
    assert got["https://e.com/2"].title_source == "jsonld:headline"
    assert got["https://e.com/3"].title_value == "T"
    assert all(r.parse_error is None for r in got.values())


def test_pages_with_a_parse_error_are_skipped(spark, monkeypatch):
    outcomes = spark.createDataFrame([("k1", "extracted", None), ("k2", "extracted", None)], "url_key string, outcome string, reason string")
    signals = spark.createDataFrame([("k1", None), ("k2", "AssertionError")], "url_key string, parse_error string")
    got = {r.url_key: (r.outcome, r.reason) for r in extract.mark_parse_errors(outcomes, signals).collect()}
    assert got == {"k1": ("extracted", None), "k2": ("skipped", "parse_error")}


def test_header_names_without_case(spark):
    rows = [("https://e.com/h", 200, "<title>x</title>", {"CONTENT-type": "text/html", "eTag": "1", "Last-modified": "d"})]
    r = extract.capture_index(captures_from_rows(spark, rows)).first()
    assert (r.content_type, r.etag, r.last_modified) == ("text/html", "1", "d")


def test_first_meta_only_and_empty_content(spark):
    html = (
        '<html><head><meta name="description" content=""><meta name="description" content="second">'
        '<meta property="og:description" content="og"></head></html>'
    )
    r = _pages(spark, {"https://e.com/m": html})["https://e.com/m"]
    assert (r.description_value, r.description_source, r.description_confidence) == ("og", "og:description", 0.8)


def test_no_head_uses_whole_document_and_nested_title():
    s = parse_signals("<title>T</title><p>x</p>", "https://e.com/")
    assert s["has_head"] is False and s["title"] == "T"
    s = parse_signals("<head><title>A <b>B</b></title></head>", "https://e.com/")
    assert s["title"] is None  # two children: no single string
    s = parse_signals("<head><title><b><i> Deep </i></b></title></head>", "https://e.com/")
    assert s["title"] == "Deep"  # a chain of single-child tags has a string
    s = parse_signals("<head><title>&amp; &quot;q&quot;</title></head>", "https://e.com/")
    assert s["title"] == '& "q"'


def test_outcomes_and_incremental_validators(spark):
    caps = captures_from_rows(
        spark,
        [
            ("https://e.com/ok", 200, "<title>ok</title>", {"content-type": "text/html", "etag": "v1"}),
            ("https://e.com/same", 200, "<title>same</title>", {"content-type": "text/html", "etag": "v2"}),
            ("https://e.com/nm", 304, "", {}),
            ("https://e.com/err", 500, "", {}),
        ],
    )
    index = extract.capture_index(caps)
    disc = spark.createDataFrame(
        [("r", u, "crawl", i) for i, u in enumerate(["https://e.com/ok", "https://e.com/same", "https://e.com/nm",
                                                     "https://e.com/err", "https://e.com/none"])],
        "run_id string, url string, provenance string, ord long",
    )
    vals = spark.createDataFrame([("https://e.com/same", "v2", None)], "url string, etag string, last_modified string")
    out = {r.url: (r.outcome, r.reason, r.outcome_status) for r in extract.extraction_outcomes(disc, index, vals, True).collect()}
    assert out["https://e.com/ok"] == ("extracted", None, 200)
    assert out["https://e.com/same"] == ("skipped", "not_modified", 304)
    assert out["https://e.com/nm"] == ("skipped", "not_modified", 304)
    assert out["https://e.com/err"] == ("skipped", "http_error", 500)
    assert out["https://e.com/none"] == ("skipped", "http_error", 404)
    plain = {r.url: r.outcome for r in extract.extraction_outcomes(disc, index).collect()}
    assert plain["https://e.com/same"] == "extracted"  # validators are opt-in
    pages = extract.extracted_pages(extract.extraction_outcomes(disc, index), extract.page_signals(caps, index))
    rec = {r.url: r for r in pages.collect()}
    assert rec["https://e.com/ok"].provenance.discovery == "crawl" and rec["https://e.com/ok"].title == "ok"


def test_only_wanted_pages_are_parsed_without_body_shuffle(spark):
    rows = [(f"https://e.com/{i}", 200, f"<title>T{i}</title>") for i in range(6)] + [("https://e.com/0", 200, "<title>newer</title>")]
    caps = captures_from_rows(spark, rows)
    keys = extract.capture_index(caps).filter("url_key IN ('https://e.com/0', 'https://e.com/3')")
    for limit in (extract.KEY_BROADCAST_ROWS, 0):
        sig = extract.page_signals(caps, keys, broadcast_rows=limit)
        assert {r.url_key: r.title for r in sig.collect()} == {"https://e.com/0": "newer", "https://e.com/3": "T3"}
        plan = sig._jdf.queryExecution().executedPlan().toString()
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("body" in line or "html" in line for line in shuffled)


def test_single_page(spark):
    caps = captures_from_rows(spark, [("https://e.com/a", 200, "<head><title>A</title></head>"), ("https://e.com/b", 404, "")])
    r = extract.index_page("https://E.com/a", caps, "r", "manual").first()
    assert (r.title, r.provenance.discovery, r.provenance.title, r.confidence.title) == ("A", "manual", "title", 1.0)
    assert extract.index_page("https://e.com/b", caps, "r").count() == 0
    assert extract.index_page("https://e.com/none", caps, "r").count() == 0


def test_key_filter_ahead_of_the_parser(spark):
    """Above the broadcast bound the parser still sees the wanted pages and hardly any other."""
    from pyspark.sql import functions as F

    rows = [(f"https://k.com/p{i}", 200, f"<title>t{i}</title>") for i in range(1500)]
    caps = captures_from_rows(spark, rows)
    keys = extract.capture_index(caps).filter(F.col("url_key").rlike("p[0-9]?[0-9]$"))
    wanted, exact = extract.wanted_pages(caps, keys, broadcast_rows=0)
    assert not exact and 100 <= wanted.count() <= 100 + 0.01 * 1500
    few = extract.page_signals(caps, keys, broadcast_rows=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, extract.page_signals(caps, keys).collect())) and few.count() == 100


def test_stored_body_sizes_spare_the_bodies(spark):
    from pyspark.sql import functions as F

    caps = captures_from_rows(spark, [("https://k.com/a", 200, "abc"), ("https://k.com/b", 200, "")])
    stored = caps.withColumn("body_bytes", F.octet_length("body"))
    assert sorted(map(str, extract.capture_index(stored).collect())) == sorted(map(str, extract.capture_index(caps).collect()))
    blank = stored.withColumn("body", F.lit(None).cast("string"))
    assert sorted(r.body_bytes for r in extract.capture_index(blank).collect()) == [0, 3]


def _stage_bytes(spark):
    from sitelens.session import stage_folder

    folder = stage_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_signals_query_stores_no_texts(spark):
    from sitelens.plans import catalog

    before = _stage_bytes(spark)
    got = catalog.q_e1_signals(spark, "/root/testdata/sf0.001")
    rows = got.collect()
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(rows) == documents.count() and any(len(r.ld_description or "") > 1000 for r in rows)
    assert _stage_bytes(spark) - before < 0.5 * documents.agg(F.sum(F.octet_length("text"))).first()[0]


def test_more_keys_than_are_broadcast(spark, monkeypatch):
    rows = [(f"https://a.example.com/{i}", 200, f"2024-01-0{1 + j}", f"<title>{i} {j}</title>") for i in range(60) for j in range(3)]
    rows.append((None, 200, "2024-01-01", "<title>none</title>"))
    caps = spark.createDataFrame(rows, "url string, status_code int, at string, body string").withColumn("fetched_at", F.to_timestamp("at")).withColumn(
        "headers", F.create_map(F.lit("Content-Type"), F.lit("text/html")))
    signals = lambda **options: sorted((r.url_key, r.title) for r in extract.page_signals(caps, **options).collect())
    want = [(f"https://a.example.com/{i}", f"{i} 2") for i in range(60)]
    assert signals() == signals(broadcast_rows=0) == sorted(want)
    # A filter that lets every page through: the others are still left out.
    monkeypatch.setattr(extract, "may_contain_hash", lambda words, h, bits: F.lit(True))
    assert signals(broadcast_rows=0) == sorted(want)
