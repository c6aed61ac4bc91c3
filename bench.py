"""Time every query and print one JSON line.

Each query is written to the no-op sink, so that all its rows and columns are computed. Environment:
BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEATS (the median of the repeats counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from keyspan.plans.queries import all_queries  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("keyspan-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        # The bench tables are a few MB; without this, adaptive execution runs most stages in one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in ("gaze", "before_after_summary", "outlier_filtered"):  # start the JVM, compile, read the files once
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(repeats)), 4) for name in queries}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds for all queries (median of repeats each)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "repeats": repeats,
            }
        )
    )


if __name__ == "__main__":
    main()
