"""X-series helpers, store write rules and histogram percentiles."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sitelens.operators import audit, insights
from sitelens.sources import store


def test_robots_rules_longest_match(spark):
    body = (
        "User-agent: googlebot\nDisallow: /\n\nUser-agent: *\nDisallow: /private/\nAllow: /private/ok\n"
        "Disallow: /tmp\nDisallow:\n"
    )
    robots = spark.createDataFrame([("r", body)], "run_id string, body string")
    rules = {(r.kind, r.prefix) for r in insights.robots_rules(robots).collect()}
    assert rules == {("disallow", "/private/"), ("allow", "/private/ok"), ("disallow", "/tmp")}
    urls = spark.createDataFrame(
        [("r", u) for u in ["https://e.com/", "https://e.com/private/x", "https://e.com/private/ok/1", "https://e.com/tmpfile"]],
        "run_id string, url string",
    )
    got = {r.url: r.allowed for r in insights.robots_allowed(urls, insights.robots_rules(robots)).collect()}
    assert got == {
        "https://e.com/": True,
        "https://e.com/private/x": False,
        "https://e.com/private/ok/1": True,
        "https://e.com/tmpfile": False,
    }


def test_robots_shared_groups_and_wildcards(spark):
    body = "User-agent: *\nUser-agent: foo\nDisallow: /a # note\nDisallow: /*.pdf$\nDisallow: /s?q=\nAllow: /a/*/ok\n\nUser-agent: x\nDisallow: /\n"
    rules = insights.robots_rules(spark.createDataFrame([("r", body)], "run_id string, body string"))
    urls = {"/a/b": False, "/a/b/ok": True, "/x.pdf": False, "/x.pdf?d=1": True, "/s?q=1": False, "/s": True, "": True}
    df = spark.createDataFrame([("r", "https://e.com" + u) for u in urls], "run_id string, url string")
    got = {r.url.removeprefix("https://e.com"): r.allowed for r in insights.robots_allowed(df, rules).collect()}
    assert got == urls


def test_markdown_metadata(spark):
    docs = [
        ("# Title here\n\nFirst line\nsecond line\n\nNext para\n",),
        ("intro\n#   Spaced   \n\n\nOnly para",),
        ("no heading at all",),
    ]
    df = spark.createDataFrame(docs, "body string")
    t, d = insights.markdown_metadata(F.col("body"))
    got = [(r.t, r.d) for r in df.select(t.alias("t"), d.alias("d")).collect()]
    assert got[0] == ("Title here", "First line second line")
    assert got[1] == ("Spaced", "Only para")
    assert got[2][0] is None


def test_link_audit_reasons(spark):
    rows = [
        ("https://e.com/p", "e.com", 0, "https://e.com/a"),
        ("https://e.com/p", "e.com", 1, "https://x.org/b"),
        ("https://e.com/p", "e.com", 2, "https://e.com/a#frag"),
        ("https://e.com/p", "e.com", 3, "https://e.com/s.css"),
        ("https://e.com/p", "e.com", 4, "https://e.com/login"),
        ("https://e.com/p", "e.com", 5, "https://e.com/s.css"),
    ]
    df = spark.createDataFrame(rows, "page_url string, hostname string, pos int, link string")
    got = {r.pos: r.reason for r in insights.link_audit(df, [".html", ""]).collect()}
    assert got == {0: None, 1: "external", 2: "duplicate", 3: "extension_filtered", 4: "non_content_path", 5: "extension_filtered"}


def test_upsert_insert_ignore_transitions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [("a", 1), ("b", 20), ("c", 30)]
    runs = spark.createDataFrame([("r", "h", "queued", 0)], "run_id string, host string, status string, n int")
    saves = spark.createDataFrame([("r", "running", 2, 1), ("r", "completed", 3, 2), ("x", "queued", 0, 1)], "run_id string, status string, n int, save int")
    got = store.upsert(runs, saves, ["run_id"], order="save", mutable=["status", "n"]).orderBy("run_id").collect()
    assert [tuple(r) for r in got] == [("r", "h", "completed", 3), ("x", None, "queued", 0)]
    table, inserted = store.insert_ignore(old, new.unionByName(new), ["k"])
    assert [r.k for r in inserted.collect()] == ["c"] and table.count() == 3
    t0 = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(
        [("w", 0, "queued", t0), ("w", 1, "processing", t0), ("w", 2, "processing", t0), ("w", 3, "completed", t0)],
        "id string, seq int, state string, updated_at timestamp_ntz",
    )
    tr = [(r.from_state, r.to_state) for r in store.changed_transitions(log, ("seq",)).orderBy("created_at", "to_state").collect()]
    assert sorted(tr, key=str) == sorted([(None, "queued"), ("queued", "processing"), ("processing", "completed")], key=str)


def test_accept_targets(spark):
    urls = ["https://e.com/x", "/rel", "mailto:x@e.com", "1http://bad", "https://e.com/x"]
    sub = spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "submission_id string, url string")
    runs, items, rejects = store.accept_targets(sub)
    ids = [r.run_id for r in runs.collect()]
    assert [r.hostname for r in runs.collect()] == ["e.com"] * 2 and len(set(ids)) == 2
    assert [(r.run_id, r.state, r.stage) for r in items.collect()] == [(i, "queued", "discovery") for i in ids]
    assert {r.url: r.reason for r in rejects.collect()} == {
        "/rel": "missing scheme", "mailto:x@e.com": "missing host", "1http://bad": "missing scheme"
    }


def test_quantized_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.exponential(3.0, 500), 3)
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", 1.0)], "k string, v double")
    out = {r.k: r for r in audit.quantized_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).collect()}
    assert abs(out["g"].p50 - np.percentile(vals, 50)) < 1e-9
    assert abs(out["g"].p95 - np.percentile(vals, 95)) < 1e-9
    assert out["g"].p0 == vals.min() and out["h"].p50 == 1.0


def test_keyed_row_number_matches_window_on_skew(spark):
    from pyspark.sql import Window

    from sitelens.functions.ordering import keyed_row_number

    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {(r.k, r.v): r.rn for r in keyed_row_number(df, ["k"], ["v"], num_partitions=6).collect()}
    w = Window.partitionBy("k").orderBy("v")
    want = {(r.k, r.v): r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_keyed_row_number_with_struct_order(spark):
    from sitelens.functions.ordering import keyed_row_number

    rows = [("s", (t, [k]), f"u{t}{k}") for t in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "run_id string, ord struct<tier:int,key:array<bigint>>, url string")
    got = [(r.ord.tier, r.ord.key[0]) for r in keyed_row_number(df, ["run_id"], ["ord", "url"], "pos", 5).orderBy("pos").collect()]
    assert got == sorted(got) and len(got) == 80


def test_quantized_percentiles_microseconds(spark):
    vals = [0.000001 * i for i in (5, 1, 9, 3, 7)]
    df = spark.createDataFrame([("g", v) for v in vals], "k string, v double")
    r = audit.quantized_percentiles(df, ["k"], "v", {"p50": 0.5, "p25": 0.25}, per_unit=1_000_000).first()
    assert abs(r.p50 - np.percentile(vals, 50)) < 1e-12 and abs(r.p25 - np.percentile(vals, 25)) < 1e-12


def test_percentiles_with_one_outlier(spark):
    """One value of a million seconds among ten-second ones: still exact, in ranges that shrink to single values."""
    import numpy as np

    rows = [10.0 + i / 1000 for i in range(3000)] + [1_000_000.0]
    df = spark.createDataFrame([("a", x) for x in rows] + [("b", 5.0), ("c", None)], "k string, v double")
    out = {r.k: r for r in audit.quantized_percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99, "p100": 1.0}, buckets=64).collect()}
    assert set(out) == {"a", "b"} and out["b"].p50 == 5.0
    for name, p in (("p50", 50), ("p99", 99), ("p100", 100)):
        assert abs(out["a"][name] - np.percentile(rows, p)) < 1e-6


def test_latency_sketches_merge_within_their_error(spark):
    """One sketch per run, many runs of different sizes and speeds."""
    rows = spark.sql("""
        SELECT concat('r', floor(sqrt(id))) AS run_id, if(id % 3 = 0, 'sitemap', 'spider') AS strategy,
               if(id % 11 = 0, NULL, pmod(xxhash64(id), 100000) * (1 + id % 7)) AS latency_ms FROM range(60000)""")
    sketches = insights.latency_sketches(rows)
    assert sketches.count() > 400
    found = insights.latency_percentiles(sketches)
    for r in insights.latency_rank_errors(rows, found).collect():
        assert max(r.p50_error, r.p95_error, r.p99_error) <= insights.LATENCY_RANK_ERROR, r
    assert sum(r.attempts for r in found.collect()) == rows.filter("latency_ms IS NOT NULL").count()
    small = spark.createDataFrame([("a", "s", 5.0), ("b", "s", 1.0), ("c", "s", 3.0), ("d", "t", None)], "run_id string, strategy string, latency_ms double")
    got = insights.latency_percentiles(insights.latency_sketches(small)).collect()
    assert [(r.strategy, r.attempts, r.fastest_ms, r.p50_ms, r.slowest_ms) for r in got] == [("s", 3, 1.0, 3.0, 5.0)]
