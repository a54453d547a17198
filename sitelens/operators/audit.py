"""Lifecycle audit and metrics (L1-L14) over the audit tables.

Inputs: ``work_item_transitions`` (work_item_id, from_state, to_state,
created_at), ``crawl_events`` (id, run_id, name, system, started_at,
completed_at, metadata JSON), ``runs`` and ``artifacts``.  Every metric is
one aggregation; the only broadcast is the fixed four-row table of legal
transitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.config import ALLOWED_TRANSITIONS, FAILURE_CODES
from sitelens.session import materialize

# Upper bounds (seconds) of the stage-duration histogram buckets.
DURATION_BUCKETS = (1, 10, 60, 300)


def duration_seconds(start: str = "started_at", end: str = "completed_at") -> Column:
    """End - start in seconds (microsecond exact), NULL while open."""
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(1_000_000.0)


def allowed_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALLOWED_TRANSITIONS), "from_state string, to_state string")


def transition_violations(transitions: DataFrame) -> DataFrame:
    """L1: transitions that the state machine forbids (creation rows with
    no from-state are not transitions)."""
    allowed = F.broadcast(allowed_transitions(transitions.sparkSession))
    t = transitions.filter(F.col("from_state").isNotNull())
    return t.join(allowed, ["from_state", "to_state"], "left_anti").select(
        "work_item_id", "from_state", "to_state", "created_at"
    )


def state_gauge(transitions: DataFrame) -> DataFrame:
    """L2: items currently in each state (+1 on entry, -1 on exit)."""
    deltas = transitions.select(
        F.explode(
            F.array(
                F.struct(F.col("to_state").alias("state"), F.lit(1).alias("d")),
                F.struct(F.col("from_state").alias("state"), F.lit(-1).alias("d")),
            )
        ).alias("x")
    ).filter(F.col("x.state").isNotNull())
    return deltas.groupBy(F.col("x.state").alias("state")).agg(F.sum("x.d").cast("long").alias("items"))


def run_outcomes(runs: DataFrame) -> DataFrame:
    """L3: finished runs by outcome."""
    r = runs.filter(F.col("status").isin("completed", "failed"))
    outcome = F.when(F.col("status") == "completed", "success").otherwise("failure")
    return r.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).cast("long").alias("runs"))


def _outcome() -> Column:
    return F.get_json_object("metadata", "$.outcome")


def stage_outcomes(events: DataFrame) -> DataFrame:
    """L4: finished stage executions by (stage, outcome)."""
    s = events.filter(F.col("name").startswith("stage.") & F.col("completed_at").isNotNull())
    return s.groupBy(F.col("system").alias("stage"), _outcome().alias("outcome")).agg(
        F.count(F.lit(1)).cast("long").alias("executions")
    )


def quantized_percentiles(
    df: DataFrame, keys: list[str], value: str, ps: dict[str, float], per_unit: int = 1_000_000, buckets: int = 4096
) -> DataFrame:
    """Percentiles with linear interpolation (``percentile_cont``) over
    values in units of ``1 / per_unit`` (microseconds by default, what the
    audit log records, so nothing is rounded away).

    A distributed selection: every wanted rank starts with the whole range of
    its key.  A round cuts each wanted range into at most ``buckets`` equal
    parts, counts the values in them (partial aggregation) and goes on with the
    part that holds the rank, until the parts are single values.  The rounds
    follow from the widest range (two for ten seconds, four for a million, in
    microseconds), wherever the values lie in it; no window sees more than
    ``buckets`` rows and no task holds or sorts the values of a key.
    """
    from pyspark.sql import Window

    v = df.filter(F.col(value).isNotNull()).select(*keys, F.round(F.col(value) * per_unit).cast("long").alias("x"))
    ends = materialize(v.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")), "value-ends")
    widest = ends.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 0
    rank_of = lambda p, f: f(F.lit(p) * (F.col("n") - 1)).cast("long")
    ranks = F.array_distinct(F.array(*[rank_of(p, f) for p in ps.values() for f in (F.floor, F.ceil)]))
    wanted = ends.select(*keys, F.explode(ranks).alias("rank"), F.col("low").alias("lo"), (F.col("high") - F.col("low") + 1).alias("width"),
                         F.lit(0).cast("long").alias("base"))
    upto = Window.partitionBy(*keys, "lo").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    while widest > 1:
        ranges = wanted.select(*keys, "lo", "width").distinct().withColumn("step", F.ceil(F.col("width") / buckets).cast("long"))
        inside = v.join(ranges, keys).filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("lo") + F.col("width")))
        parts = inside.groupBy(*keys, "lo", "step", F.floor((F.col("x") - F.col("lo")) / F.col("step")).alias("b")).agg(F.count(F.lit(1)).alias("c"))
        parts = parts.withColumn("upto", F.sum("c").over(upto))
        held = wanted.join(parts, [*keys, "lo"]).filter(
            (F.col("rank") >= F.col("base") + F.col("upto") - F.col("c")) & (F.col("rank") < F.col("base") + F.col("upto"))
        )
        wanted = materialize(held.select(
            *keys, "rank", (F.col("lo") + F.col("b") * F.col("step")).alias("lo"), F.col("step").alias("width"),
            (F.col("base") + F.col("upto") - F.col("c")).alias("base")), "value-ranges")
        widest = -(-widest // buckets)
    chosen = wanted.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("at")).join(ends, keys)
    cols = []
    for k, p in ps.items():
        lo, hi = (F.col("at")[rank_of(p, f)] for f in (F.floor, F.ceil))
        pos = F.lit(p) * (F.col("n") - 1)
        cols.append(((lo + (hi - lo) * (pos - F.floor(pos))) / float(per_unit)).alias(k))
    return chosen.select(*keys, *cols)


def stage_durations(events: DataFrame) -> DataFrame:
    """Duration distribution of successful stage executions (failed
    executions are not timed)."""
    s = events.filter(F.col("name").startswith("stage.") & (_outcome() == "success")).withColumn(
        "d", duration_seconds()
    )
    buckets = []
    lo = None
    for hi in DURATION_BUCKETS:
        cond = F.col("d") <= hi if lo is None else (F.col("d") > lo) & (F.col("d") <= hi)
        buckets.append(F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(f"le_{hi}s"))
        lo = hi
    buckets.append(F.sum(F.when(F.col("d") > lo, 1).otherwise(0)).cast("long").alias(f"gt_{lo}s"))
    s = s.withColumnRenamed("system", "stage")
    stats = s.groupBy("stage").agg(
        F.count(F.lit(1)).cast("long").alias("executions"),
        F.round(F.sum("d"), 6).alias("total_seconds"),
        F.round(F.avg("d"), 6).alias("avg_seconds"),
        *buckets,
    )
    pct = quantized_percentiles(s, ["stage"], "d", {"p50_seconds": 0.5, "p95_seconds": 0.95})
    pct = pct.select("stage", F.round("p50_seconds", 6).alias("p50_seconds"), F.round("p95_seconds", 6).alias("p95_seconds"))
    return stats.join(pct, "stage")


def business_metrics(runs: DataFrame, events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pages indexed (finished extraction executions of completed runs),
    run duration and artifact size distributions."""
    done = runs.filter(F.col("status") == "completed").select(
        "run_id", duration_seconds("created_at", "completed_at").alias("run_seconds")
    )
    pages = (
        events.filter((F.col("system") == "extraction") & F.col("completed_at").isNotNull())
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    sizes = artifacts.select("run_id", F.octet_length("llms_txt").alias("bytes"))
    j = done.join(pages, "run_id", "left").join(sizes, "run_id", "left").withColumn("all", F.lit(1))
    stats = j.groupBy("all").agg(
        F.count(F.lit(1)).cast("long").alias("completed_runs"),
        F.coalesce(F.sum("pages"), F.lit(0)).cast("long").alias("pages_indexed_total"),
        F.round(F.avg("run_seconds"), 6).alias("avg_run_seconds"),
        F.round(F.max("run_seconds"), 6).alias("max_run_seconds"),
        F.round(F.avg("bytes"), 6).alias("avg_artifact_bytes"),
        F.max("bytes").cast("long").alias("max_artifact_bytes"),
    )
    pct = quantized_percentiles(j, ["all"], "run_seconds", {"p50_run_seconds": 0.5})
    out = stats.join(pct, "all", "left")
    return out.select(
        "completed_runs", "pages_indexed_total", "avg_run_seconds",
        F.round("p50_run_seconds", 6).alias("p50_run_seconds"), "max_run_seconds", "avg_artifact_bytes", "max_artifact_bytes",
    )


def event_durations(events: DataFrame) -> DataFrame:
    """Duration of each event, NULL while open."""
    return events.select("id", "run_id", duration_seconds().alias("duration"))


def log_lines(events: DataFrame) -> DataFrame:
    """One structured JSON log line per event, keys sorted."""
    return events.select(
        "id",
        F.to_json(
            F.struct(
                F.col("name"),
                _outcome().alias("outcome"),
                F.col("run_id"),
                F.col("system"),
            )
        ).alias("line"),
    )


def failure_codes(events: DataFrame, rejects: DataFrame, missing: DataFrame) -> DataFrame:
    """Failure class -> HTTP-like code -> occurrences: invalid input
    (rejected submissions), not found (``missing``: requests for runs or
    documents that do not exist) and stage failures (stage events)."""
    codes = dict(FAILURE_CODES)
    failed = events.filter(F.col("name").startswith("stage.") & (_outcome() == "failure"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("occurrences")).select(
            F.lit(name).alias("failure_class"), F.lit(codes[name]).cast("long").alias("http_code"), "occurrences"
        )

    out = counted(rejects, "invalid_input").unionByName(counted(missing, "not_found")).unionByName(counted(failed, "stage_failure"))
    return out.filter("occurrences > 0")


def missing_documents(requests: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Requests (run_id) that answer 404: no such run, or a run without
    a document."""
    served = runs.select("run_id").join(artifacts.select("run_id"), "run_id", "left_semi")
    return requests.join(served, "run_id", "left_anti")
