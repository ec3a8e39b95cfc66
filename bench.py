"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local
cores (default 8), BENCH_RUNS the timed runs per query after one warm-up
(default 3, the median counts).  Results go to Spark's no-op sink, so that every
row and column is computed and none travels to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "valid_hourly_means",
    "scan_instrument_log",
    "interval_flag_join",
    "regime_join",
    "time_average",
    "diurnal_profile",
    "agg_fanout_stats",
    "agg_conditional_mean",
    "agg_five_number",
    "agg_linear_fit",
    "impute_group_mean",
    "row_index",
    "run_length_encode",
    "run_ids",
    "interpolate_linear",
    "fill_down",
    "unpivot_paired",
    "left_join_key",
    "daily_to_subdaily_asof",
    "pipe_night_zero",
    "pipe_za_zero",
    "pipe_calibration",
    "pipe_concentration",
    "pipe_final_series",
    "pipe_merge_hourly",
    "pipe_pss_no_nitrate",
    "pipe_daily_enhancement",
    "pipe_variant_compare",
    "pipe_nitrate_airmass",
    "step_response_time",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("STRANDLINE_SHARED", "/tmp/strandline-shared"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from catalog.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
