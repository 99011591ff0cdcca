"""Headline queries, warm, median of three: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores, BENCH_QUERIES an optional comma-separated choice.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from outlay.queries import base, registry
from outlay.session import build_session

HEADLINE = (
    "w1_w2_chase_dedup",
    "a1_monthly_spending",
    "a2_daily_spending",
    "a3_f9_weekly_spending",
    "x1_f8_month_by_category",
    "j3_u2_previous_period_by_category",
    "j2_f20_w16_snapshot_categories",
    "x4_a11_a12_a14_change_header",
    "x5_profile_statistics",
    "x8_bm25",
    "x9_vector_search",
    "x10_j8_w17_hybrid_search",
    "j7_paired_calls",
    "x12_j6_f33_run_index",
    "x13_run_summary",
    "x15_budget_check",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="outlay-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries, seconds = registry(), {}
    for name in chosen:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            base.run(entries[name], spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
