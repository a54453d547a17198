"""Extraction (S2, E1-E11): captured responses -> page records.

Plan shape at scale: the capture table holds the bodies and is by far the
largest input.  Bodies are only read by the map-only HTML pass
(``page_signals``); every join afterwards moves small rows keyed by the
normalised URL.  No body crosses a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.config import DESCRIPTION_TIERS, EXTRACT_EVENT_DESC_MAX, NO_SOURCE, TITLE_TIERS
from sitelens.functions.html import extract_signals
from sitelens.functions.keyfilter import filter_bits, hash_filter, may_contain_hash
from sitelens.functions.urls import normalize_sql
from sitelens.session import materialize
from sitelens.sources.captures import header


def url_key(e: str) -> Column:
    """Join key of a URL: its P9 serialisation (falls back to the text)."""
    return F.expr(f"coalesce({normalize_sql(e)}, {e})")


def capture_index(captures: DataFrame) -> DataFrame:
    """S2 lookup table: the latest capture per URL key, without the body.

    Columns: url_key, fetched_at, status_code, content_type, etag,
    last_modified, body_bytes.  Partial aggregation combines repeated captures of a hot
    URL before the shuffle.  A capture table that stores ``body_bytes`` spares
    this scan the bodies; without the column they are measured.
    """
    body_bytes = F.col("body_bytes") if "body_bytes" in captures.columns else F.octet_length("body")
    small = captures.select(
        url_key("url").alias("url_key"),
        F.struct(
            F.col("fetched_at"),
            F.col("status_code"),
            header("content-type").alias("content_type"),
            header("etag").alias("etag"),
            header("last-modified").alias("last_modified"),
            body_bytes.cast("int").alias("body_bytes"),
        ).alias("c"),
    )
    return small.groupBy("url_key").agg(F.max("c").alias("c")).select("url_key", "c.*")


#: Keys up to this number are broadcast to the scan; beyond it the scan gets a
#: filter of fixed size (8 MB at most), and the few other pages that pass it
#: are taken out behind the parser.
KEY_BROADCAST_ROWS = 100_000


def wanted_pages(captures: DataFrame, keys: DataFrame, broadcast_rows: int = KEY_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The successful captures named by ``keys`` (url_key, fetched_at), before
    they are parsed, and whether the selection is exact.  Beyond
    ``broadcast_rows`` it lets about 0.3 % of the other pages through (more
    than that only when the keys outgrow the largest filter)."""
    ok = captures.filter(F.col("status_code") == 200).select(
        url_key("url").alias("url_key"), "fetched_at", "url", F.col("body").alias("html")
    )
    n = keys.count()
    if n <= broadcast_rows:
        return ok.join(F.broadcast(keys), ["url_key", "fetched_at"], "left_semi"), True
    bits = filter_bits(n)
    h = F.xxhash64("url_key", "fetched_at")
    words = hash_filter(keys.select(h.alias("h")), "h", bits)
    return ok.filter(may_contain_hash(words, h, bits)), False


def page_signals(captures: DataFrame, keys: DataFrame | None = None, broadcast_rows: int = KEY_BROADCAST_ROWS) -> DataFrame:
    """E1 on the successful captures named by ``keys`` (url_key, fetched_at;
    default: the latest capture of every URL), a map-only pass.

    Returns url_key + the signal columns of ``sitelens.functions.html``.
    Bodies cross no shuffle either way: unwanted pages are skipped before the
    parser (``wanted_pages``); if that may let some through, their keys are
    found first (small rows), and signals meet only these.
    """
    keys = (keys if keys is not None else capture_index(captures)).select("url_key", "fetched_at")
    wanted, exact = wanted_pages(captures, keys, broadcast_rows)
    if exact:
        return extract_signals(wanted, keep=["url_key"]).drop("url")
    both = ["url_key", "fetched_at"]
    wanted = wanted.filter(F.col("url_key").isNotNull() & F.col("fetched_at").isNotNull())
    others = materialize(wanted.select(*both).join(keys.hint("shuffle_merge"), both, "left_anti").distinct(), "other-pages")
    sig = extract_signals(wanted, keep=both)
    return sig.join(others, both, "left_anti").drop("fetched_at", "url")


def fetch(candidates: DataFrame, index: DataFrame, url_col: str = "url") -> DataFrame:
    """Attach the captured response to each candidate URL; a URL that
    was never captured answers 404."""
    c = candidates.withColumn("url_key", url_key(url_col))
    out = c.join(index.hint("shuffle_merge"), "url_key", "left")  # a row per page: never broadcast
    return out.withColumn("status_code", F.coalesce(F.col("status_code"), F.lit(404)))


# ---------------------------------------------------------------------------
# E2-E5 cascades
# ---------------------------------------------------------------------------
def meta_content(metas: Column, *, name: str | None = None, prop: str | None = None) -> Column:
    """Content of the first meta tag with the given name / property
    (NULL when that first tag has no content)."""
    if name is not None:
        hit = F.filter(metas, lambda m: m["name"] == F.lit(name))
    else:
        hit = F.filter(metas, lambda m: m["property"] == F.lit(prop))
    return F.get(hit, 0)["content"]


def _cascade(values: list[Column], tiers) -> Column:
    cands = F.array(
        *[
            F.struct(v.alias("v"), F.lit(src).alias("src"), F.lit(float(conf)).alias("conf"))
            for v, (src, conf) in zip(values, tiers)
        ]
    )
    return F.get(F.filter(cands, lambda x: x["v"].isNotNull() & (x["v"] != "")), 0)


def title_choice() -> Column:
    """struct(v, src, conf) of the first non-empty title signal."""
    metas = F.col("metas")
    return _cascade(
        [
            F.col("title"),
            meta_content(metas, prop="og:title"),
            meta_content(metas, prop="twitter:title"),
            F.col("ld_headline"),
        ],
        TITLE_TIERS,
    )


def description_choice() -> Column:
    """struct(v, src, conf) of the first non-empty description."""
    metas = F.col("metas")
    return _cascade(
        [
            meta_content(metas, name="description"),
            meta_content(metas, prop="og:description"),
            meta_content(metas, prop="twitter:description"),
            F.col("ld_description"),
        ],
        DESCRIPTION_TIERS,
    )


def apply_cascades(signals: DataFrame) -> DataFrame:
    """Signals -> title, description, their sources and confidences."""
    t, d = title_choice(), description_choice()
    return signals.select(
        "*",
        t["v"].alias("title_value"),
        F.coalesce(t["src"], F.lit(NO_SOURCE)).alias("title_source"),
        F.coalesce(t["conf"], F.lit(0.0)).alias("title_confidence"),
        d["v"].alias("description_value"),
        F.coalesce(d["src"], F.lit(NO_SOURCE)).alias("description_source"),
        F.coalesce(d["conf"], F.lit(0.0)).alias("description_confidence"),
    )


# ---------------------------------------------------------------------------
# E6-E11
# ---------------------------------------------------------------------------
def extraction_outcomes(
    discovered: DataFrame,
    index: DataFrame,
    validators: DataFrame | None = None,
    incremental: bool = False,
) -> DataFrame:
    """One outcome per discovered URL.

    outcome is 'extracted' or 'skipped'; reason is NULL, 'not_modified' or
    'http_error' (``mark_parse_errors`` adds 'parse_error').  With ``incremental`` a stored validator equal to the
    capture's (ETag first, else Last-Modified) counts as a 304.
    """
    f = fetch(discovered, index)
    unchanged = F.lit(False)
    if incremental and validators is not None:
        v = validators.select(
            url_key("url").alias("url_key"),
            F.col("etag").alias("old_etag"),
            F.col("last_modified").alias("old_last_modified"),
        )
        f = f.join(v, "url_key", "left")
        unchanged = F.coalesce(
            F.when(F.col("old_etag").isNotNull(), F.col("old_etag") == F.col("etag")).when(
                F.col("old_last_modified").isNotNull(),
                F.col("old_last_modified") == F.col("last_modified"),
            ),
            F.lit(False),
        )
    skipped_304 = (F.col("status_code") == 304) | unchanged
    return f.select(
        "*",
        F.when(skipped_304 | (F.col("status_code") != 200), F.lit("skipped"))
        .otherwise(F.lit("extracted"))
        .alias("outcome"),
        F.when(skipped_304, F.lit("not_modified"))
        .when(F.col("status_code") != 200, F.lit("http_error"))
        .alias("reason"),
        F.when(skipped_304, F.lit(304)).otherwise(F.col("status_code")).alias("outcome_status"),
    )


def mark_parse_errors(outcomes: DataFrame, signals: DataFrame) -> DataFrame:
    """Outcomes whose page the tokenizer gave up on become skipped
    (``parse_error``), so such a page leaves an event instead of half a record."""
    broken = signals.filter(F.col("parse_error").isNotNull()).select("url_key", F.lit(True).alias("_broken"))
    j = outcomes.join(broken, "url_key", "left")
    hit = F.coalesce(F.col("_broken"), F.lit(False)) & (F.col("outcome") == "extracted")
    return j.withColumns(
        {
            "outcome": F.when(hit, F.lit("skipped")).otherwise(F.col("outcome")),
            "reason": F.when(hit, F.lit("parse_error")).otherwise(F.col("reason")),
        }
    ).select(*outcomes.columns)


def extracted_pages(outcomes: DataFrame, signals: DataFrame) -> DataFrame:
    """Page records of the extracted outcomes.

    Columns: run_id, url, title, description, provenance struct,
    confidence struct, ord, url_key.
    """
    ok = outcomes.filter(F.col("outcome") == "extracted").select("run_id", "url", "provenance", "ord", "url_key")
    # Signals hold texts: shuffled, never broadcast.
    rich = apply_cascades(ok.join(signals.hint("shuffle_merge"), "url_key", "inner"))
    return rich.select(
        "run_id",
        "url",
        F.col("title_value").alias("title"),
        F.col("description_value").alias("description"),
        F.struct(
            F.col("provenance").alias("discovery"),
            F.col("title_source").alias("title"),
            F.col("description_source").alias("description"),
        ).alias("provenance"),
        F.struct(
            F.col("title_confidence").alias("title"),
            F.col("description_confidence").alias("description"),
        ).alias("confidence"),
        "ord",
        "url_key",
    )


def index_page(url: str, captures: DataFrame, run_id: str, provenance: str = "crawl") -> DataFrame:
    """The page record of a single URL (E8 on one row); no row when it
    was not captured or not answered with 200.  Only captures of the URL are
    parsed."""
    spark = captures.sparkSession
    one = spark.createDataFrame([(run_id, url, provenance, 0)], "run_id string, url string, provenance string, ord int")
    own = captures.join(F.broadcast(one.select(url_key("url").alias("_key"))), url_key("url") == F.col("_key"), "left_semi")
    index = capture_index(own)
    outcomes = extraction_outcomes(one, index)
    return extracted_pages(outcomes, page_signals(own, index))


def new_validators(outcomes: DataFrame) -> DataFrame:
    """Validators taken from the responses of extracted pages."""
    return outcomes.filter(F.col("outcome") == "extracted").select(
        "url", "etag", "last_modified", F.col("fetched_at")
    )


def page_events(outcomes: DataFrame, pages: DataFrame, at: str = "2024-01-31 00:00:00") -> DataFrame:
    """One audit event per attempted URL, in the schema of the event log
    (metadata as JSON text with its null fields kept).  A page event starts
    and ends at the time of the response it is about, ``at`` if there is none."""
    p = pages.select(
        "run_id", "url", "title", "description",
        F.col("provenance.title").alias("title_source"),
        F.col("confidence.title").alias("title_confidence"),
        F.col("provenance.description").alias("description_source"),
        F.col("confidence.description").alias("description_confidence"),
    )
    time = F.coalesce(F.col("fetched_at"), F.to_timestamp(F.lit(at))).cast("timestamp_ntz")
    o = outcomes.select("run_id", "url", "provenance", "outcome", "reason", "outcome_status", "ord", time.alias("time"))
    j = o.join(p, ["run_id", "url"], "left")
    extracted_meta = F.to_json(
        F.struct(
            F.col("url"),
            F.col("provenance"),
            F.col("title"),
            F.col("title_source"),
            F.col("title_confidence"),
            F.substring(F.col("description"), 1, EXTRACT_EVENT_DESC_MAX).alias("description"),
            F.col("description_source"),
            F.col("description_confidence"),
        ), {"ignoreNullFields": "false"}
    )
    skipped_meta = F.to_json(
        F.struct(F.col("url"), F.col("reason"), F.col("outcome_status").alias("status_code")), {"ignoreNullFields": "false"}
    )
    extracted = F.col("outcome") == "extracted"
    return j.select(
        F.substring(F.sha2(F.concat_ws("|", "run_id", "url", F.lit("extraction")), 256), 1, 32).alias("id"),
        "run_id",
        F.when(extracted, F.lit("extraction.page_extracted"))
        .otherwise(F.lit("extraction.page_skipped"))
        .alias("name"),
        F.lit("extraction").alias("system"),
        F.col("time").alias("started_at"),
        F.col("time").alias("completed_at"),
        F.when(extracted, extracted_meta).otherwise(skipped_meta).alias("metadata"),
        "ord",
    )


def extraction_milestones(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Pages extracted and skipped, for every run."""
    done = F.col("outcome") == "extracted"
    n = outcomes.groupBy("run_id").agg(
        F.count(F.when(done, 1)).alias("pages_extracted"), F.count(F.when(~done, 1)).alias("pages_skipped")
    )
    zero = F.lit(0).cast("long")
    return runs.select("run_id").join(n, "run_id", "left").select(
        "run_id", F.coalesce("pages_extracted", zero).alias("pages_extracted"), F.coalesce("pages_skipped", zero).alias("pages_skipped")
    )
