"""Command line entry for batch runs on stored tables.

    python -m sitelens.plans.cli run --sites SITES --captures CAPTURES --out OUT
        [--files FILES] [--validators VALIDATORS --incremental] [--generated-at "YYYY-MM-DD HH:MM:SS"]

SITES: Parquet (run_id, target_url, hostname[, created_at]).
CAPTURES: Parquet of the capture schema (url, status_code, headers, body,
fetched_at).  FILES (optional, same schema): the discovery fetches, when
the crawler stores them apart; discovery then never joins page bodies.
OUT receives one Parquet table per stage output and the documents as text,
one folder per run.  The session comes from the platform (spark-submit);
the checkpoint folder must be shared.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sitelens.config import PipelineParams  # noqa: E402
from sitelens.operators import document  # noqa: E402
from sitelens.plans import jobs  # noqa: E402
from sitelens.session import clear_stages, materialize, prepare_session  # noqa: E402
from sitelens.sources import store  # noqa: E402
from sitelens.sources.captures import read_captures  # noqa: E402


def run(spark: SparkSession, sites_path: str, captures_path: str, out: str, validators_path: str | None = None,
        incremental: bool = False, generated_at: str | None = None, files_path: str | None = None,
        documents: bool = False) -> dict[str, str]:
    """All five stages for every site; returns the written paths.  The documents
    are written as ordered lines; ``documents`` adds them as one string per
    site."""
    prepare_session(spark)
    params = PipelineParams(incremental=incremental, **({"generated_at": generated_at} if generated_at else {}))
    sites = spark.read.parquet(sites_path)
    captures = read_captures(spark, captures_path)
    validators = spark.read.parquet(validators_path) if validators_path else None
    files = read_captures(spark, files_path) if files_path else None
    res = jobs.run_all_stages(sites, captures, params, validators, files=files)
    st = res.stages
    lines = materialize(st.lines, "document-lines")
    offsets = materialize(document.document_offsets(lines), "document-offsets")
    sizes = document.document_stats(lines, st.site_meta)
    previews = document.document_previews(offsets)
    outputs = {
        "discovered": res.discovery.discovered.select("run_id", "url", "provenance", F.to_json("ord").alias("ord")),
        "strategy_log": res.discovery.strategy_log,
        "rejects": res.discovery.rejects,
        "outcomes": st.outcomes.select("run_id", "url", "outcome", "reason", F.col("outcome_status").alias("status_code")),
        "pages": st.pages.drop("url_key").withColumn("ord", F.to_json("ord")),
        "canonical_pages": st.canonical_pages.withColumn("ord", F.to_json("ord")),
        "scores": st.scores,
        "artifacts": sizes.join(previews.drop("line_count"), "run_id"),
        "validators": st.validators,
        "runs": res.trail.runs,
        "work_items": res.trail.work_items,
        "transitions": res.trail.transitions,
        "events": res.trail.events,
    }
    if documents:
        outputs["documents"] = st.artifacts
    written = {}
    for name, df in outputs.items():
        path = f"{out.rstrip('/')}/{name}"
        store.write_table(df, path, "run_id" if "run_id" in df.columns else None)
        written[name] = path
    written["llms_txt"] = f"{out.rstrip('/')}/llms_txt"
    document.write_documents(offsets, written["llms_txt"])
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="sitelens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="discover, extract, canonicalise, score and render every site")
    r.add_argument("--sites", required=True)
    r.add_argument("--captures", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--files", help="captures of discovery fetches (robots, llms.txt, sitemaps), if stored apart")
    r.add_argument("--validators")
    r.add_argument("--incremental", action="store_true")
    r.add_argument("--generated-at")
    r.add_argument("--documents", action="store_true", help="also write each document as one string")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("sitelens").getOrCreate()
    written = run(spark, args.sites, args.captures, args.out, args.validators, args.incremental, args.generated_at, args.files, args.documents)
    clear_stages(spark)
    for name, path in written.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
