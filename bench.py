"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One warm-up and three runs each, every row materialized; the median counts."""
import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
QUERIES = ["totals_by_client", "models_by_client_provider_model", "models_by_workspace_model", "daily_client_models", "hourly_models", "weekly_periods", "sessions", "overview_summary", "dedup_first_wins", "dedup_max_merge", "cumulative_delta", "tiered_cost", "contribution_grades", "impute_total_single"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tokenloom.plans.queries import queries

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    times = {}
    for name in QUERIES:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "median wall time, summed over queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
