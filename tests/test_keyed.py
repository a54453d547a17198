"""Bucketed keyed table: touched buckets only, retries, versions."""

import datetime as dt

import pytest

from sitelens.sources.keyed import KEEP_VERSIONS, KeyedTable
from sitelens.sources.store import upsert
from sitelens.streaming import monitor


def _files(df):
    return df.inputFiles()


@pytest.fixture()
def table(spark):
    rows = spark.range(20_000).selectExpr("concat('k', id) AS k", "id AS v", "'a' AS fixed")
    return KeyedTable.create(rows, monitor.scratch(spark, "t-keyed"), ["k"], buckets=128)


def test_an_upsert_touches_its_buckets_only(spark, table):
    assert table.read().count() == 20_000
    batch = spark.range(100).selectExpr("concat('k', id * 7) AS k", "-id AS v")
    assert len(_files(table.read_near(batch))) <= 100
    version = table.upsert(batch)
    wrote = table.rewritten(version)
    assert 0 < len(wrote) <= 100
    new = [f for f in _files(table.read()) if f"_at={version}/" in f]
    assert len(new) == len(wrote)
    got = {r.k: (r.v, r.fixed) for r in table.read().collect()}
    assert len(got) == 20_000 and got["k7"] == (-1, "a") and got["k8"] == (8, "a")


def test_the_merge_takes_one_exchange_of_the_touched_rows(spark, table):
    batch = spark.createDataFrame([("k1", 5)], "k string, v long")
    near = table._rows(table._touched(batch, table.live(0)))
    plan = table._merged(near, batch, 128, None, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_retry_replaces_its_own_version(spark, table):
    batch = spark.createDataFrame([("k1", 100), ("new", 1)], "k string, v long")
    assert table.upsert(batch, version=7) == 7
    first = sorted(table.read().collect())
    assert table.upsert(batch, version=7) == 7  # run again
    assert sorted(table.read().collect()) == first and len(first) == 20_001
    # A run that died before its commit leaves folders that no version names.
    spark.range(3).selectExpr("concat('k', id) AS k", "id AS v", "'z' AS fixed", "0 AS _bucket").write.partitionBy("_bucket").parquet(f"{table.path}/data/_at=8")
    assert sorted(table.read().collect()) == first
    assert table.upsert(spark.createDataFrame([("k2", 9)], "k string, v long")) == 8
    assert table.read().filter("fixed = 'z'").count() == 0 and table.read().count() == 20_001


def test_same_rows_as_the_set_form(spark):
    old = spark.createDataFrame([("r", "h", "queued", 0), ("s", "i", "done", 1), (None, "n", "queued", 2)], "run_id string, host string, status string, n int")
    saves = spark.createDataFrame([("r", "running", 2, 1), ("r", "completed", 3, 2), ("x", "queued", 0, 1)], "run_id string, status string, n int, save int")
    for mutable in (None, ["status"], []):
        t = KeyedTable.create(old, monitor.scratch(spark, "t-keyed"), ["run_id"], buckets=4)
        t.upsert(saves, order=["save"], mutable=mutable)
        want = upsert(old, saves, ["run_id"], order="save", mutable=mutable if mutable != [] else ["none"])
        assert sorted(map(str, t.read().select(*old.columns).collect())) == sorted(map(str, want.collect())), mutable


def test_null_keys_empty_batches_and_empty_tables(spark):
    schema = "k string, v int"
    t = KeyedTable.create(spark.createDataFrame([], schema), monitor.scratch(spark, "t-keyed"), ["k"], buckets=4)
    assert t.exists() and t.read().count() == 0
    assert not KeyedTable(spark, t.path + "-none", ["k"]).exists()
    t.upsert(spark.createDataFrame([], schema))
    t.upsert(spark.createDataFrame([(None, 1), ("a", None)], schema))
    t.upsert(spark.createDataFrame([(None, 2, 9)], schema + ", extra int"))
    u = KeyedTable.create(spark.createDataFrame([(7, 1)], "k long, v int"), monitor.scratch(spark, "t-keyed"), ["k"], buckets=64)
    u.upsert(spark.createDataFrame([(7, 2)], schema.replace("string", "int")))  # a key of another type
    assert [tuple(r) for r in u.read().collect()] == [(7, 2)]
    assert sorted(map(tuple, t.read().collect()), key=str) == [("a", None), (None, 2)]


def test_newest_keeps_a_larger_stored_row(spark):
    schema = "k string, at timestamp_ntz, state string"
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    t = KeyedTable.create(spark.createDataFrame([("a", t1, "done")], schema), monitor.scratch(spark, "t-keyed"), ["k"], buckets=4)
    t.upsert(spark.createDataFrame([("a", t0, "late"), ("b", t0, "queued"), ("b", t1, "running")], schema), order=["at"], newest=True)
    assert {r.k: r.state for r in t.read().collect()} == {"a": "done", "b": "running"}


def test_old_versions_and_their_folders_go(spark, table):
    fs_rows = []
    for i in range(6):
        table.upsert(spark.createDataFrame([("k1", i)], "k string, v long"))
        fs_rows.append(len(_files(table.read())))
    assert table.versions() == [4, 5, 6] and len(table.versions()) == KEEP_VERSIONS
    assert len(set(fs_rows)) == 1  # a write adds no file to what is read
    bucket = table.rewritten(6)[0]
    assert [at for at in range(7) if monitor.path_exists(spark, f"{table.path}/data/_at={at}/_bucket={bucket}")] == [4, 5, 6]
    with pytest.raises(ValueError):
        table.read(before=4)
