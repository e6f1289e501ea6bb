"""Benchmark the headline queries.

Runs each query end to end (the ``noop`` sink forces the full plan without moving rows
to the driver) at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. A query's time is the median of
``$BENCH_REPEATS`` (default 3) runs, each building the DataFrame and executing it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from funnelkit.plans.catalog import QUERIES  # noqa: E402
from funnelkit.session import build_session  # noqa: E402

HEADLINE = [
    "funnel_mart",
    "reason_select",
    "label_map",
    "application_category",
    "stitch_full_outer",
    "stitch_split",
    "asof_latest_state",
    "asof_latest_state_bucketed",
    "signals_rollup",
    "latest_non_null",
    "no_file_keys",
    "enrich_chain",
    "membership_flag",
    "key_uniqueness",
    "tenure_fractional",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app_name="funnelkit-bench",
        shuffle_partitions=max(8, 2 * cpus),
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")},
    )
    # Warm-up: JVM start, JIT, class loading and codegen caches are not query time. Every
    # headline query runs once on the smallest fixture (same plans, negligible data).
    warm_dir = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    times = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in os.path.basename(sf_dir) else sf_dir
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "repeats": repeats,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
