"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query is built anew and run to the end once; all rows are produced and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from daytrace.plans.catalogue import QUERIES  # noqa: E402
from daytrace.sources.session import tune  # noqa: E402

HEADLINE = [
    "c1_app_sessions",
    "c3_coverage_intervals",
    "c11_overlap_sweep",
    "c12_cluster_cross_device",
    "e3_focus_sessions",
    "p1_distraction_burst",
    "p2_habitual_checking",
    "m1_daily_metrics",
    "m2_category_totals",
    "g2_goal_window",
    "a2_envelope_validate",
    "a10_ingest_receipt",
    "t1_content_scan",
    "t4_payload_gate",
    "s2_wake_reconcile",
]


def run(spark: SparkSession, folder: str, name: str) -> None:
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("daytrace-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    # one unmeasured run, so that the figures are those of a warm session
    start = time.perf_counter()
    run(spark, folder, "m1_daily_metrics")
    warm_up = round(time.perf_counter() - start, 3)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(spark, folder, name)
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "warm_up": warm_up,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
