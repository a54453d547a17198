"""The captured-response source (S2 input).

A crawl capture is a table ``(url, status_code, headers map, body,
fetched_at)``; a URL without a row answers 404.  ``captures_from_rows``
builds one from literal rows (tests, small replays); production captures
are Parquet tables read with ``read_captures``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("body", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
    ]
)

SITE_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("target_url", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def header(name: str, headers: str = "headers") -> Column:
    """Value of a response header; names are compared without case, the
    first one listed counts."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), 0)["value"]


def captures_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (url, status, body[, headers]) -> capture table.

    ``headers`` defaults to ``{"content-type": "text/html"}``.
    """
    base = dt.datetime(2024, 1, 1)
    out = []
    for i, r in enumerate(rows):
        url, status, body = r[0], r[1], r[2]
        headers = r[3] if len(r) > 3 else {"content-type": "text/html"}
        out.append((url, int(status), headers, body, base + dt.timedelta(seconds=i)))
    return spark.createDataFrame(out, CAPTURE_SCHEMA)


def sites_from_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """One site per target URL (run_id = the host)."""
    from urllib.parse import urlparse

    rows = [(urlparse(u).netloc, u, urlparse(u).netloc, dt.datetime(2024, 1, 1)) for u in urls]
    return spark.createDataFrame(rows, SITE_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A stored capture table (Parquet, schema enforced)."""
    return spark.read.schema(CAPTURE_SCHEMA).parquet(path)
