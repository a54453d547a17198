"""Read views over runs, work items, events and artifacts.

Each view is a projection, a filter, a ranked window per run or a small
aggregate; windows are partitioned by ``run_id`` so a run's rows stay in
one task while runs spread over the cluster.  "Now" is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.config import (
    ARTIFACT_PREVIEW_LINES,
    EVENT_DETAIL_MAX,
    EVENT_VALUE_CUT,
    EVENT_VALUE_MAX,
    HISTORY_LIMIT,
    RECENT_EVENTS,
    STAGES,
    STATUS_STAGE_EVENTS,
)
from sitelens.operators.audit import duration_seconds

# Stage labels and state icons of the run view.
STAGE_LABELS = (
    ("discovery", "Discovery"),
    ("extraction", "Extraction"),
    ("canonicalization", "Canonicalize"),
    ("scoring", "Scoring"),
    ("generation", "Generation"),
)
STATE_ICONS = (("active", "▶"), ("done", "✓"), ("failed", "✗"))


def run_status(runs: DataFrame) -> DataFrame:
    """V1: status of each run."""
    return runs.select("run_id", "hostname", "status", "score", "created_at", "completed_at")


def history(runs: DataFrame, hostname: str | None = None, limit: int = HISTORY_LIMIT) -> DataFrame:
    """V2: newest runs first, optionally for one host (a top-k report)."""
    r = runs if hostname is None else runs.filter(F.col("hostname") == hostname)
    return r.orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit).select(
        "run_id", "hostname", "status", "created_at"
    )


def work_items_in_order(items: DataFrame) -> DataFrame:
    """V3: work items of each run by creation time (a global sort, range
    partitioned, so one busy run spreads over several tasks)."""
    return items.select("run_id", "id", "stage", "state", "created_at").orderBy("run_id", "created_at", "id")


def events_in_order(events: DataFrame) -> DataFrame:
    """V4: events of each run by start time, with duration (global sort)."""
    return events.select("run_id", "id", "name", "started_at", duration_seconds().alias("duration")).orderBy(
        "run_id", "started_at", "id"
    )


def artifact_text(artifacts: DataFrame) -> DataFrame:
    """V5: document text per run."""
    return artifacts.select("run_id", "llms_txt")


def _stage_rows(runs: DataFrame) -> DataFrame:
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    return runs.select("run_id", F.explode(stages).alias("s")).select("run_id", "s.stage_no", "s.stage")


def stage_states(runs: DataFrame, items: DataFrame) -> DataFrame:
    """V6: state of each of the five stages per run: failed > active >
    done > pending.  Runs get their five stage rows by ``explode`` of a
    fixed array, not by a join."""
    flags = items.groupBy("run_id", "stage").agg(
        F.max(F.when(F.col("state") == "failed", 1).otherwise(0)).alias("f"),
        F.max(F.when(F.col("state") == "processing", 1).otherwise(0)).alias("p"),
        F.max(F.when(F.col("state") == "completed", 1).otherwise(0)).alias("c"),
    )
    s = _stage_rows(runs).join(flags, ["run_id", "stage"], "left")
    state = (
        F.when(F.col("f") == 1, "failed").when(F.col("p") == 1, "active").when(F.col("c") == 1, "done").otherwise("pending")
    )
    return s.select("run_id", "stage", "stage_no", state.alias("state"))


def current_stage(states: DataFrame) -> DataFrame:
    """V7: icon + label of the last non-pending stage, else 'queued'."""
    label = F.lit(None).cast("string")
    for stage, text in STAGE_LABELS:
        label = F.when(F.col("stage") == stage, F.lit(text)).otherwise(label)
    icon = F.lit(None).cast("string")
    for state, ch in STATE_ICONS:
        icon = F.when(F.col("state") == state, F.lit(ch)).otherwise(icon)
    active = states.filter(F.col("state") != "pending").select(
        "run_id", F.struct("stage_no", F.concat(icon, F.lit(" "), label).alias("label")).alias("k")
    )
    last = active.groupBy("run_id").agg(F.max("k").alias("k"))
    runs = states.select("run_id").distinct()
    return runs.join(last, "run_id", "left").select("run_id", F.coalesce(F.col("k.label"), F.lit("queued")).alias("label"))


def _tenths_label(units: Column, per_unit_tenth: int, suffix: str) -> Column:
    """Exact decimal formatting with one decimal: ``units / (10 *
    per_unit_tenth)`` rounded half-even in integer arithmetic."""
    q = F.floor(units / per_unit_tenth).cast("long")
    r = units - q * per_unit_tenth
    half = per_unit_tenth / 2
    t = F.when(r > half, q + 1).when(r == half, q + q % 2).otherwise(q)
    return F.concat(F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(suffix))


def _ms_label(ms: Column) -> Column:
    """'<n>ms' under a second, else seconds with one decimal."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(_tenths_label(ms, 100, "s"))


def timeline(items: DataFrame) -> DataFrame:
    """V8: per (run, stage) the last non-queued item, else the first
    queued one, with its duration label and error.  Two partial
    aggregates (max_by / min_by), no per-run window."""
    item = F.struct("id", "state", "created_at", "updated_at", "last_error")
    pos = F.struct("created_at", "id")
    queued = F.col("state") == "queued"
    best = items.groupBy("run_id", "stage").agg(
        F.max_by(F.when(~queued, item), F.when(~queued, pos)).alias("live"),
        F.min_by(F.when(queued, item), F.when(queued, pos)).alias("first_queued"),
    ).select("run_id", "stage", F.coalesce("live", "first_queued").alias("it"))
    ms = (duration_seconds("it.created_at", "it.updated_at") * 1000).cast("long")
    return best.select(
        "run_id", "stage", F.col("it.id").alias("item_id"), F.col("it.state").alias("state"),
        _ms_label(ms).alias("duration_label"), F.col("it.last_error").alias("last_error"),
    )


def _meta_pairs(sep: str, value_fn) -> Column:
    m = F.from_json("metadata", "map<string,string>")
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), value_fn(e["value"]))), sep)


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """V9: the last ``n`` events of each run, newest first, with time,
    duration label and 'k=v' metadata (values over 60 chars cut)."""
    w = Window.partitionBy("run_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    e = events.withColumn("recent_rank", F.row_number().over(w)).filter(F.col("recent_rank") <= n)
    dur = duration_seconds()
    ms = (dur * 1000).cast("long")
    cut = lambda v: F.when(F.length(v) > EVENT_VALUE_MAX, F.concat(F.substring(v, 1, EVENT_VALUE_CUT), F.lit("..."))).otherwise(v)
    return e.select(
        "run_id", "id", "recent_rank", F.date_format("started_at", "HH:mm:ss").alias("time"), "name", "system",
        F.when(dur.isNull(), F.lit("")).otherwise(_ms_label(ms)).alias("duration_label"),
        _meta_pairs(" ", cut).alias("meta"),
    )


def event_table(events: DataFrame) -> DataFrame:
    """Every event with time, rounded milliseconds and details."""
    dur = duration_seconds()
    return events.select(
        "run_id", "id", F.date_format("started_at", "HH:mm:ss").alias("time"), "name", "system",
        F.when(dur.isNull() | (dur == 0), F.lit(None)).otherwise(F.round(dur * 1000)).cast("long").alias("duration_ms"),
        _meta_pairs(", ", lambda v: F.substring(v, 1, EVENT_DETAIL_MAX)).alias("details"),
    )


def artifact_preview(artifacts: DataFrame, max_lines: int = ARTIFACT_PREVIEW_LINES) -> DataFrame:
    """Line and word counts and the preview (first lines) of each
    document."""
    lines = F.split(F.regexp_replace("llms_txt", "\n$", ""), "\n")
    n = F.size(lines)
    return artifacts.select(
        "run_id",
        n.cast("long").alias("line_count"),
        F.size(F.filter(F.split(F.col("llms_txt"), r"\s+"), lambda w: w != "")).cast("long").alias("word_count"),
        (n > max_lines).alias("truncated"),
        F.when(n > max_lines, F.array_join(F.slice(lines, 1, max_lines), "\n")).otherwise(F.col("llms_txt")).alias("preview"),
    )


def run_groups(runs: DataFrame) -> DataFrame:
    """Active (queued / running) versus history."""
    return runs.select(
        "run_id", "status",
        F.when(F.col("status").isin("queued", "running"), "active").otherwise("history").alias("group"),
    )


def status_summary(runs: DataFrame) -> DataFrame:
    """Completed / total, failed, in progress and the exit code
    (1 when anything failed, else 2 while anything runs, else 0)."""
    agg = runs.agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("long").alias("completed"),
        F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("long").alias("failed"),
        F.sum(F.when(F.col("status").isin("running", "queued"), 1).otherwise(0)).cast("long").alias("in_progress"),
    )
    code = F.when(F.col("failed") > 0, 1).when(F.col("in_progress") > 0, 2).otherwise(0)
    return agg.select(
        "*",
        F.format_string("%d/%d completed, %d failed, %d in progress", "completed", "total", "failed", "in_progress").alias("summary"),
        code.cast("long").alias("exit_code"),
    )


def last_stage_events(events: DataFrame, n: int = STATUS_STAGE_EVENTS) -> DataFrame:
    """The last ``n`` stage events per run with duration and outcome."""
    s = events.filter(F.col("name").startswith("stage."))
    w = Window.partitionBy("run_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    s = s.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)
    dur = duration_seconds()
    return s.select(
        "run_id", "id", "name", "from_end",
        F.when(dur.isNull() | (dur == 0), F.lit("--"))
        .otherwise(F.concat((dur * 1000).cast("long").cast("string"), F.lit("ms")))
        .alias("duration_label"),
        F.coalesce(F.get_json_object("metadata", "$.outcome"), F.lit("?")).alias("outcome"),
    )


def elapsed_label(start: str, now: str) -> Column:
    """Whole seconds since ``start`` as '<s>s', '<m>m <s>s' or
    '<h>h <m>m'."""
    secs = F.floor(duration_seconds(start, f"TIMESTAMP_NTZ'{now}'")).cast("long")
    return (
        F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s")))
        .when(secs < 3600, F.format_string("%dm %ds", F.floor(secs / 60).cast("long"), (secs % 60)))
        .otherwise(F.format_string("%dh %dm", F.floor(secs / 3600).cast("long"), F.floor((secs % 3600) / 60).cast("long")))
    )


def percent_label(col: str) -> Column:
    """A 0-1 score (4 decimals) as a percentage with one decimal."""
    units = F.round(F.coalesce(F.col(col), F.lit(0.0)) * 10000).cast("long")
    return _tenths_label(units, 10, "%")


def run_labels(runs: DataFrame, now: str) -> DataFrame:
    """Elapsed time and score label of each run."""
    return runs.select("run_id", elapsed_label("created_at", now).alias("elapsed"), percent_label("score").alias("score_label"))
