"""Benchmark: run the headline queries and print one JSON line.

  BENCH_SF_DIR  input tables (default /root/testdata/sf0.1)
  BENCH_CPUS    local[N] (default 8)
  BENCH_QUERIES comma-separated subset (default: HEADLINE)

Each query is executed in full into Spark's ``noop`` sink (every column is
computed, nothing is collected); the time is the median wall-clock of BENCH_RUNS
(default 3) runs after one warm-up query that starts the JVM and loads the
Python modules.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pair_features",
    "pair_features_by_customer",
    "purchase_cycles",
    "month_series",
    "label_pairs",
    "holdout_evaluation",
    "all_family_metrics_items",
    "item_scores",
    "top_k_subcats",
    "global_ordinal",
    "csv_roundtrip",
    "train_ranker",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from cartpulse.plans.catalog import QUERIES
    from cartpulse.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="cartpulse-bench")
    # warm-up: JVM, codegen caches and Python imports, not timed
    QUERIES["table_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
