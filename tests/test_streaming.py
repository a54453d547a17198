"""R1-R5 with availableNow file streams: duplicates, late rows, upserts."""

import datetime as dt

from pyspark.sql import functions as F

from sitelens.sources.keyed import KeyedTable
from sitelens.streaming import monitor

EV = "id string, run_id string, name string, system string, started_at timestamp_ntz, completed_at timestamp_ntz, metadata string"
T0 = dt.datetime(2024, 1, 10)


def _ev(i, minutes, outcome="success"):
    t = T0 + dt.timedelta(minutes=minutes)
    return (f"e{i}", "r", "stage.discovery", "discovery", t, t + dt.timedelta(seconds=1), f'{{"outcome": "{outcome}"}}')


def test_dedup_and_late_rows(spark):
    b1 = [_ev(1, 0), _ev(2, 5), _ev(2, 5), _ev(3, 60)]
    b2 = [_ev(3, 60), _ev(4, 61)]
    b3 = [("late", "r", "stage.discovery", "discovery", T0 - dt.timedelta(days=1), None, "{}"), _ev(5, 62)]
    schema = spark.createDataFrame([], EV).schema
    out = monitor.replay(spark, [spark.createDataFrame(b, EV) for b in (b1, b2, b3)], schema, "t", monitor.dedup_events)
    ids = sorted(r.id for r in monitor.read_table(spark, out, "id string").collect())
    assert ids == ["e1", "e2", "e3", "e4", "e5"]


def test_windows_update_mode_and_sessions(spark):
    b1 = [_ev(1, 0), _ev(2, 10, "failure"), _ev(3, 100)]
    b2 = [_ev(4, 130)]
    schema = spark.createDataFrame([], EV).schema
    batches = [spark.createDataFrame(b, EV) for b in (b1, b2)]
    out = monitor.replay(spark, batches, schema, "t", lambda s: monitor.stage_throughput(s, "1 hour"), mode="update")
    rows = {(r.window_start.hour, r.executions, r.failures) for r in monitor.read_table(spark, out, "x int", key=["window_start", "stage"]).collect()}
    assert rows == {(0, 2, 1), (1, 1, 0), (2, 1, 0)}
    static = spark.createDataFrame(b1 + b2, EV)
    sess = sorted((r.session_start.minute, r.events) for r in monitor.activity_sessions(static).collect())
    assert [e for _, e in sess] == [2, 2]  # 0,10 | 100,130


def test_latest_item_state_upserts(spark):
    schema = "work_item_id string, from_state string, to_state string, created_at timestamp_ntz, seq int"
    b1 = [("w", None, "queued", T0, 0), ("w", "queued", "processing", T0, 1)]
    b2 = [("w", "processing", "completed", T0 + dt.timedelta(seconds=5), 2), ("v", None, "queued", T0, 0)]
    src, out, ckpt = (monitor.scratch(spark, n) for n in ("t-in", "t-out", "t-ckpt"))
    late = [("w", "queued", "processing", T0, 1)]
    for rows in (b1, b2, late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        monitor.keep_latest_state(monitor.file_stream(spark, src, spark.createDataFrame([], schema).schema), out, ckpt, buckets=4)
    got = KeyedTable(spark, out, ["work_item_id"]).read().collect()
    assert {r.work_item_id: r.state for r in got} == {"w": "completed", "v": "queued"} and len(got) == 2


def _uncommit_last_batch(spark, ckpt):
    """Forget that the last batch was committed, so that it is run again."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(ckpt).getFileSystem(spark._jsc.hadoopConfiguration())
    commits = sorted(int(f.getPath().getName()) for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(ckpt + "/commits")) if f.getPath().getName().isdigit())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{ckpt}/commits/{commits[-1]}"), False)


def test_restart_and_replayed_batch_leave_no_duplicates(spark):
    schema = spark.createDataFrame([], EV).schema
    src, out, ckpt = (monitor.scratch(spark, n) for n in ("t-in", "t-out", "t-ckpt"))
    assert monitor.read_table(spark, out, "id string").count() == 0  # never ran
    for part in ([_ev(1, 0), _ev(2, 5)], [_ev(2, 5), _ev(3, 7)]):
        spark.createDataFrame(part, EV).write.mode("append").parquet(src)
        monitor.run_to_table(monitor.dedup_events(monitor.file_stream(spark, src, schema)), out, ckpt)
    assert sorted(r.id for r in monitor.read_table(spark, out, "id string").collect()) == ["e1", "e2", "e3"]
    _uncommit_last_batch(spark, ckpt)  # run again into its own folder
    monitor.run_to_table(monitor.dedup_events(monitor.file_stream(spark, src, schema)), out, ckpt)
    assert sorted(r.id for r in monitor.read_table(spark, out, "id string").collect()) == ["e1", "e2", "e3"]


def test_recrawl_compares_with_validators_of_earlier_batches(spark):
    from sitelens.sources.captures import CAPTURE_SCHEMA, captures_from_rows

    page = lambda title: f"<html><head><title>{title}</title></head></html>"
    batches = [
        [("https://e.com/a", 200, page("A"), {"ETag": "1"}), ("https://e.com/b", 200, page("B"), {"etag": "old"})],
        [("https://e.com/a", 200, page("A again"), {"ETAG": "1"}), ("https://e.com/b", 200, page("B2"), {"Etag": "new"})],
    ]
    stored = spark.createDataFrame([("https://e.com/b", "old", None)], "url string, etag string, last_modified string")
    src, pages, vals, ckpt = (monitor.scratch(spark, n) for n in ("t-in", "t-pages", "t-vals", "t-ckpt"))
    for rows in batches:
        captures_from_rows(spark, rows).write.mode("append").parquet(src)
        monitor.incremental_extract(monitor.file_stream(spark, src, CAPTURE_SCHEMA), stored, pages, vals, ckpt)
    read = lambda: sorted(map(tuple, KeyedTable(spark, pages, ["url"]).read().select("url", "title", "outcome").collect()))
    want = [("https://e.com/a", "A", "extracted"), ("https://e.com/b", "B2", "extracted")]
    assert read() == want
    _uncommit_last_batch(spark, ckpt)
    monitor.incremental_extract(monitor.file_stream(spark, src, CAPTURE_SCHEMA), stored, pages, vals, ckpt)
    assert read() == want and KeyedTable(spark, vals, ["url_key"]).read().count() == 2


def test_a_batch_reads_what_its_urls_need(spark):
    """The files a batch opens do not grow with the batches before it."""
    schema = "work_item_id string, from_state string, to_state string, created_at timestamp_ntz, seq int"
    src, out, ckpt = (monitor.scratch(spark, n) for n in ("t-in", "t-out", "t-ckpt"))
    opened = []
    for i in range(5):
        rows = spark.createDataFrame([("w", None, f"s{i}", T0, i)], schema)
        rows.write.mode("append").parquet(src)
        monitor.keep_latest_state(monitor.file_stream(spark, src, rows.schema), out, ckpt, buckets=4)
        opened.append(len(KeyedTable(spark, out, ["work_item_id"]).read_near(rows).inputFiles()))
    assert opened == [1] * 5


def test_recrawl_skips_pages_with_a_parse_error(spark, monkeypatch):
    from sitelens.operators import extract
    from sitelens.sources.captures import CAPTURE_SCHEMA, captures_from_rows

    def signals(captures, keys):
        hit = F.when(F.col("url").endswith("/b"), F.lit("AssertionError"))
        return captures.join(keys, ["url_key", "fetched_at"], "left_semi").select("url_key", "url", hit.alias("parse_error"))

    monkeypatch.setattr(extract, "page_signals", signals)
    monkeypatch.setattr(extract, "apply_cascades", lambda s: s.withColumns({"title_value": F.lit("T"), "description_value": F.lit("D")}))
    stored = spark.createDataFrame([], "url string, etag string, last_modified string")
    src, pages, vals, ckpt = (monitor.scratch(spark, n) for n in ("t-in", "t-pages", "t-vals", "t-ckpt"))
    captures_from_rows(spark, [(f"https://e.com/{c}", 200, "x", {"etag": c}) for c in "ab"]).write.parquet(src)
    monitor.incremental_extract(monitor.file_stream(spark, src, CAPTURE_SCHEMA), stored, pages, vals, ckpt, buckets=4)
    got = sorted(map(tuple, KeyedTable(spark, pages, ["url"]).read().collect()), key=str)
    assert got == [("https://e.com/a", "T", "D", "extracted", None), ("https://e.com/b", None, None, "skipped", "parse_error")]
    assert [r.etag for r in KeyedTable(spark, vals, ["url_key"]).read().collect()] == ["a"]
