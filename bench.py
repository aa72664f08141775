"""Time queries at one scale and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_QUERIES a
comma-separated choice or ``all`` (the headline queries by default) and BENCH_RUNS
the repetitions, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from mendwell.plans.catalog import QUERIES
from mendwell.session import build_session

# At least one query per group of operators.
HEADLINE = [
    "trips_daily",
    "trips_weather",
    "gold_incremental",
    "interim_trips_weather",
    "missing_partitions",
    "partition_profile",
    "land_new_partitions",
    "schema_drift",
    "json_columns_to_rows",
    "dq_unique_combo",
    "dq_relationships",
    "dq_summary",
    "dq_from_footers",
    "fault_detection_matrix",
    "capture_incidents",
    "incident_state",
    "incident_state_incremental",
    "classify_incidents",
    "lineage_neighbours",
    "recent_runs",
    "log_tail",
    "incident_index",
    "similar_incidents",
    "similar_open_incidents",
    "build_prompts",
    "validate_responses",
    "decide_actions",
    "reports",
    "coerce_quarantine",
    "metric_rate",
    "metric_increase_day",
    "latency_p95",
    "retry_plan",
    "stream_incidents",
    "stream_metric_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    asked = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if asked == "all" else [q for q in asked.split(",") if q] or HEADLINE
    spark = build_session(
        "mendwell-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before anything is timed.
    QUERIES["trips_daily"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
