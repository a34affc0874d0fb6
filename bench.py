"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = (
    "parse_ssh",
    "parse_hdfs",
    "combined_features",
    "rule_alerts",
    "hybrid_alerts",
    "hdfs_rules",
    "bgl_rules",
    "tb_rules",
    "alpha_sweep",
    "grid_tune",
    "ngram_detect",
    "iforest_scores",
    "detect_hdfs",
    "detect_bgl",
    "detect_thunderbird",
)
# Jobs over all four line logs; the others read one.
FOUR_LOGS = ("combined_features", "rule_alerts", "hybrid_alerts")
# Jobs whose rate is reported, with the table that gives the number of sessions.
RATES = {"hdfs_rules": "blocks_per_sec", "bgl_rules": "windows_per_sec", "tb_rules": "windows_per_sec"}


def main() -> None:
    from queryset import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vigilog-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="vigilog-bench-"))
        # Generated methods above this size are never compiled by the JVM; below it they are.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start workers and compile before anything is timed.
    QUERIES["iforest_trees"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds, rates = {}, {}
    for name in HEADLINES:
        start = time.perf_counter()
        result = QUERIES[name](spark, sf_dir)
        if name in RATES:
            rows = result.count()
        else:
            result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if name in RATES:
            rates[f"{name}_{RATES[name]}"] = round(rows / seconds[name])
        rates[f"{name}_lines_per_sec"] = round(lines * (4 if name in FOUR_LOGS else 1) / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
