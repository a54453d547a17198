"""Every registered query against its DuckDB oracle on the smallest
driver tables (the driver's correctness gate, run locally)."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _rows(cols, records):
    import datetime as dt
    import decimal

    def norm(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
        if isinstance(v, (dt.datetime, dt.date)):
            return v.isoformat()
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        if isinstance(v, bool):
            return int(v)
        return v

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    from sitelens.sources.tables import DRIVER_TABLES

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_contract(spark):
    import __spark_entry__ as se

    df = se.entry(spark)
    assert df.columns == ["run_id", "hostname", "llms_txt", "size_bytes", "entry_count"]
    assert df.count() > 0
    from sitelens.plans import catalog, oracle

    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(catalog.queries()) <= set(se.queries()) and set(oracle.oracle_sql()) <= set(se.oracle_sql())


_TYPES = {
    "LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
    "BooleanType()": "BOOLEAN", "TimestampNTZType()": "TIMESTAMP", "TimestampType()": "TIMESTAMP WITH TIME ZONE",
}


def test_every_query_matches_oracle(spark, duck):
    from sitelens.plans import catalog, oracle

    bad = []
    sqls = oracle.oracle_sql()
    for name, fn in catalog.queries().items():
        df = fn(spark, SF)
        got = _rows(df.columns, [tuple(r) for r in df.collect()])
        rel = duck.sql(sqls[name])
        types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        spark_types = {f.name: _TYPES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
        res = duck.execute(sqls[name])
        want = _rows([c[0] for c in res.description], res.fetchall())
        if spark_types != types or got != want:
            bad.append(name)
    assert bad == []
