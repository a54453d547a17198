"""Structured Streaming over the event log and captured responses.

Sources are file streams (Parquet directories).  Sinks are ``foreachBatch``
writers.  R1-R3 append: every micro-batch overwrites its own ``batch_id=<n>``
folder, so a replayed batch rewrites the same rows instead of adding copies.
R4 and R5 keep one row per key in a bucketed keyed table
(``sources.keyed``): a batch reads and writes the buckets of its own keys,
whatever came before it.  The checkpoint is an argument: a query started again
on the same checkpoint and output goes on where it stopped.  State is bounded
by watermarks (R1-R3) or is the sink table (R4, R5).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir, materialize
from sitelens.sources.captures import header
from sitelens.sources.keyed import KeyedTable
from sitelens.sources.store import latest_by_key


# ---------------------------------------------------------------------------
# Plumbing
# ---------------------------------------------------------------------------
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's reliable checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/sitelens-stream/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """All files of ``path`` that the query's checkpoint has not seen yet."""
    return spark.readStream.schema(schema).parquet(path)


def run_to_table(
    stream: DataFrame,
    out_path: str,
    checkpoint: str,
    mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Run ``stream`` until its input is drained (availableNow) into a table
    with one folder per micro-batch; ``transform`` is applied to each batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return out_path


def replay(
    spark: SparkSession,
    batches: list[DataFrame],
    schema,
    name: str,
    build: Callable[[DataFrame], DataFrame],
    mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Append each of ``batches`` to a stream input and run the query on it,
    every run starting again from the same checkpoint.  Returns the output."""
    src, out, checkpoint = (scratch(spark, f"{name}-{part}") for part in ("in", "out", "checkpoint"))
    for df in batches:
        df.write.mode("append").parquet(src)
        run_to_table(build(file_stream(spark, src, schema)), out, checkpoint, mode, transform)
    return out


def read_table(
    spark: SparkSession, path: str, schema: str, key: list[str] | None = None, order: list[str] | None = None
) -> DataFrame:
    """Read a sink table; with ``key`` keep one row per key, the largest by
    ``order`` and the newest batch.  A sink that never ran is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    if key:
        df = df.withColumn("_order", F.struct(*(order or []), "batch_id"))
        df = latest_by_key(df, key, "_order").drop("_order")
    return df.drop("batch_id")


# ---------------------------------------------------------------------------
# Monitors over the event stream
# ---------------------------------------------------------------------------
def _event_time(events: DataFrame) -> DataFrame:
    """Watermarks need TIMESTAMP event time; the log keeps TIMESTAMP_NTZ
    (UTC wall clock), so an ``event_time`` column carries the cast."""
    return events.withColumn("event_time", F.col("started_at").cast("timestamp"))


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The event feed without redelivered copies (same ``id``); rows
    older than the watermark are late and dropped."""
    return (
        _event_time(events).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"]).drop("event_time")
    )


def stage_throughput(
    events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """R2: executions and failures per stage per window (tumbling, or sliding
    every ``slide``)."""
    failed = F.get_json_object("metadata", "$.outcome") == "failure"
    return (
        _event_time(events)
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window, slide).alias("w"), F.col("system").alias("stage"))
        .agg(
            F.count(F.lit(1)).alias("executions"),
            F.sum(F.when(failed, 1).otherwise(0)).alias("failures"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "stage",
            F.col("executions").cast("long").alias("executions"),
            F.col("failures").cast("long").alias("failures"),
        )
    )


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Sessions of activity per run (events closer than ``gap``)."""
    src = _event_time(events).withWatermark("event_time", delay) if delay else events.withColumn("event_time", F.col("started_at"))
    return (
        src.groupBy("run_id", F.session_window("event_time", gap).alias("s"))
        .agg(F.count(F.lit(1)).cast("long").alias("events"))
        .select(
            "run_id",
            F.col("s.start").cast("timestamp_ntz").alias("session_start"),
            F.col("s.end").cast("timestamp_ntz").alias("session_end"),
            "events",
        )
    )


def latest_item_state(transitions: DataFrame) -> DataFrame:
    """Latest state of each work item in a batch of transitions.  Applied
    per micro-batch: the keyed sink (``keep_latest_state``) holds the states, the
    query itself none."""
    latest = F.max(F.struct("created_at", "seq", "to_state"))
    return transitions.groupBy("work_item_id").agg(latest.alias("m")).select(
        "work_item_id", F.col("m.to_state").alias("state"), F.col("m.created_at").alias("updated_at"), F.col("m.seq").alias("seq")
    )


def keep_latest_state(stream: DataFrame, out_path: str, checkpoint: str, buckets: int = 64) -> None:
    """R5 as a table: the states of each micro-batch are upserted into a keyed
    table (work_item_id, state, updated_at, seq); a transition that arrives after
    a later one of its item changes nothing."""
    table = KeyedTable(stream.sparkSession, out_path, ["work_item_id"])
    if not table.exists():
        none = stream.sparkSession.createDataFrame([], stream.schema)
        KeyedTable.create(latest_item_state(none), out_path, ["work_item_id"], buckets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        table.upsert(latest_item_state(batch), order=["updated_at", "seq"], newest=True, version=batch_id + 1)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# ---------------------------------------------------------------------------
# Incremental recrawl
# ---------------------------------------------------------------------------
def unchanged(etag: Column, last_modified: Column) -> Column:
    """Does the stored validator (``old_etag``, else ``old_last_modified``)
    equal the response's?"""
    return F.coalesce(
        F.when(F.col("old_etag").isNotNull(), F.col("old_etag") == etag).when(
            F.col("old_last_modified").isNotNull(), F.col("old_last_modified") == last_modified
        ),
        F.lit(False),
    )


def incremental_extract(
    captures: DataFrame, validators: DataFrame, out_pages: str, out_validators: str, checkpoint: str, buckets: int = 64
) -> None:
    """For each micro-batch of captured responses, only rows whose
    validators changed (or that have none) reach extraction; their pages
    and new validators are upserted, and later batches are compared with the
    validators of the earlier ones.

    ``captures`` is a streaming DataFrame of the capture schema;
    ``validators`` the (url, etag, last_modified) table before the first batch.
    Both outputs are keyed tables: pages (url, title, description, outcome,
    reason) and validators (url_key, etag, last_modified).  A batch reads and
    writes the buckets of its own URLs, and is known by its number, so a replay
    sees the validators before it.  A page that the parser gave up on is skipped
    as ``parse_error``, as in the batch job: it leaves no validator, and a page
    stored earlier keeps its title and description.
    """
    from sitelens.operators import extract

    spark = captures.sparkSession
    known, pages = KeyedTable(spark, out_validators, ["url_key"]), KeyedTable(spark, out_pages, ["url"])
    if not known.exists():
        rows = validators.groupBy(extract.url_key("url").alias("url_key")).agg(F.max(F.struct("etag", "last_modified")).alias("v"))
        KeyedTable.create(rows.select("url_key", "v.*"), out_validators, ["url_key"], buckets)
    if not pages.exists():
        empty = spark.createDataFrame([], "url string, title string, description string, outcome string, reason string")
        KeyedTable.create(empty, out_pages, ["url"], buckets)

    def process(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        b = batch.filter(F.col("status_code") == 200).withColumns(
            {"url_key": extract.url_key("url"), "etag": header("etag"), "last_modified": header("last-modified")}
        )
        old = known.read_near(b.select("url_key"), before=version).withColumnsRenamed({"etag": "old_etag", "last_modified": "old_last_modified"})
        changed = b.drop("body").join(old, "url_key", "left").filter(~unchanged(F.col("etag"), F.col("last_modified")))
        newest = changed.groupBy("url_key").agg(F.max(F.struct("fetched_at", "etag", "last_modified")).alias("m"))
        new = materialize(newest.select("url_key", "m.*"), "recrawl-keys")
        # The body-free side comes first; the HTML pass reads the batch once
        # more, restricted to its keys.
        sig = extract.page_signals(b.drop("etag", "last_modified"), new.select("url_key", "fetched_at"))
        sig = materialize(extract.apply_cascades(sig).select(
            "url_key", F.col("title_value").alias("title"), F.col("description_value").alias("description"), "parse_error"
        ), "recrawl-pages")
        failed = F.col("parse_error").isNotNull()
        good = sig.filter(~failed).select(
            F.col("url_key").alias("url"), "title", "description", F.lit("extracted").alias("outcome"), F.lit(None).cast("string").alias("reason")
        )
        broken = sig.filter(failed).select(F.col("url_key").alias("url"), F.lit("skipped").alias("outcome"), F.lit("parse_error").alias("reason"))
        held = pages.read_near(broken, before=version).select("url", "title", "description")
        pages.upsert(good.unionByName(broken.join(held, "url", "left")), order=["title", "description"], version=version)
        known.upsert(new.join(sig.filter(failed), "url_key", "left_anti").drop("fetched_at"), version=version)

    q = captures.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
