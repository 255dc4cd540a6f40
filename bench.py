"""Time the registered queries and print one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the local cores, BENCH_QUERIES
(comma-separated) a subset. Each query is planned and run in full into a sink
that discards rows, so planning counts. One small run first loads the classes.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from jobloom.plans.catalog import QUERIES


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("jobloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # HotSpot leaves methods above 8000 bytecodes uncompiled; the parse of a
        # page generates larger ones unless the stage is split.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        run(spark, small, "page_fields")
    seconds = {name: run(spark, folder, name) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


def run(spark: SparkSession, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


if __name__ == "__main__":
    main()
