"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3)
and BENCH_QUERIES (comma-separated names) can be set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "aggregate_windows", "label_packets", "align_clock", "per_attack_recall", "binary_metrics", "roc_auc", "calibrated_alerts",
    "gateway_mac_flips", "seq_jumps", "parse_telemetry", "decode_frames", "feature_stats", "detector_report", "elastic_windows",
    "stratified_split", "fit_tree",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from airlens.plans import all_queries
    from airlens.session import local_session

    spark = local_session(cpus)
    queries, times = all_queries(), {}
    for name in names:
        taken = []
        for _ in range(runs + 1):  # the first run warms up and is left out
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "median seconds, sum over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
