"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the cores and
BENCH_RUNS the timed runs per query after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession

from impactspark.registry import ENTRIES

HEADLINES = (
    "equity_impact",
    "outcome_core",
    "outer_merge",
    "percent_rescale",
    "dedup_rows",
    "clean_fill",
    "build_master",
    "missing_profile",
    "iqr_outliers",
    "dup_classify",
    "duplicate_rows",
    "enhanced_master",
    "impact_score",
    "impact_resilience_top20",
    "state_vulnerability",
    "group_stats",
    "lineitem_group_stats",
    "describe_lineitem",
    "correlations",
    "histogram_events",
    "scenario_grid",
    "scenario_compare",
    "scenario_top10",
    "impact_summary",
    "lod_state",
    "join_equity",
    "bill_clean",
    "bill_params",
    "bill_money",
    "bill_impact",
    "stream_publish",
    "published_equity",
    "quality_score",
    "feature_matrix",
    "split_counts",
    "regression_metrics",
    "csv_split",
    "dictionary_codes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("impactspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
