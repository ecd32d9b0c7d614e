"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list, or "all").
Each query is built and run to a no-op sink; the second run is reported. Nothing is shared between
queries or runs: every run starts from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession

from embergrid.plans.queries import QUERIES

HEADLINE = [
    "grid_daily", "static_cells", "merged_daily_fast", "band_counts", "fine_strips", "pooled_prior", "fit_ratios",
    "cross_validate", "fill_no_record", "doy_climatology", "season_timing", "cell_months", "layer_scale",
    "tile_delta_encode", "point_in_area", "box_touches_area", "nearest_place", "live_area_counts", "nowcast_rank",
    "stream_live_cell_days",
]


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(line.strip(" +-:*()0123456789").startswith(("Exchange", "BroadcastExchange")) for line in plan.splitlines())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, plans = {}, {}
    for name in names:
        for _ in range(2):
            t0 = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        plans[name] = exchanges(df)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "exchanges": plans, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
