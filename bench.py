"""Time the headline queries, each from the given tables on (nothing staged before).

BENCH_SF_DIR and BENCH_CPUS choose data and cores; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boutspark.staging import release  # noqa: E402
from checks import catalog, workspace  # noqa: E402

HEADLINE = (
    "flagship_contacts",
    "baseline_median",
    "feeding_detect",
    "bout_measures",
    "summary_two_well",
    "binned_treatment",
    "cumulative_pi",
    "light_marks",
    "breaking_point",
    "bleeding_matrix",
    "bootstrap",
    "anova_two_way",
    "sweep_link_gap",
    "price_contacts",
    "price_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boutspark-bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="boutspark-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # start the JVM's and Python's workers before the clock does
    catalog.QUERIES["baseline_median"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in names:
        workspace.forget()
        release(spark)
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cores": int(cores),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
