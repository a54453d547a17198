"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query runs end to end (plan + execution into a no-op sink) with the
per-session stage caches cleared, so every timing includes its inputs.
Session start-up and one warm-up action are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "site_index_captured",
    "site_index_tiered",
    "e2_cascade",
    "p9_normalized_links",
    "l5_stage_durations",
    "v9_recent_events",
    "v8_timeline",
    "s1_accept_targets",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sitelens.plans import catalog
    from sitelens.sources import fixtures
    from sitelens.session import build_session

    spark = build_session(f"local[{cpus}]", app_name="sitelens-bench", shuffle_partitions=int(cpus) * 2)
    qs = catalog.queries()
    # Warm the JVM and the Python workers once (not part of any query).
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(8).mapInArrow(lambda it: it, "id long").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for cache in (catalog._FULL_RUN_CACHE, catalog._INPUT_CACHE, catalog._CASCADE_CACHE, catalog._CAPTURED_CACHE,
                      catalog._SIGNALS_CACHE, fixtures._SITE_PAGES):
            cache.clear()
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    spark.stop()
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
