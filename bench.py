"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 5, after one warm-up; the median counts), BENCH_ALL=1 for
every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from checks.registry import QUERIES
from shopgrain.session import build_session

HEADLINE = [
    "b1_quarterly_growth",
    "b5_channel_split",
    "e1_conversion_rate",
    "k1_master_kpis",
    "k2_quarterly_channels",
    "c1_monthly_mix",
    "c4_weekly_volume",
    "d2_funnel_rates",
    "d4_funnel_by_device",
    "k3_site_funnel",
    "x3_bounce_rate",
    "x7_checkout_test",
    "p1_monthly_margin",
    "p5_month_by_product",
    "p8_monthly_refunds",
    "p10_lifetime_summary",
    "m1_feature_launch",
    "m2_attachment_matrix",
    "m3_basket_values",
    "l1_visit_buckets",
    "l2_days_to_return",
    "l5_value_per_user",
    "a12_early_lineitem_count",
    "a5_duplicate_keys",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    settings = {"spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false"}
    spark = build_session(f"local[{cpus}]", "bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    line = {
        "metric": "headline queries, median of runs, summed",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
