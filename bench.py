"""Time every registered query and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each result is computed in full and
thrown away; nothing is collected. Each query runs BENCH_REPEATS times (twice by default) and the
best time counts, so starting up is charged to none. `python bench.py word_count ...` times only
these.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from wordwood.operators import word_counts
from wordwood.plans import QUERIES


def session(cpus: str, scratch: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wordwood-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        # A few splits per core: a gigabyte would else be nine splits for eight cores.
        .config("spark.sql.files.maxPartitionBytes", "32m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    with tempfile.TemporaryDirectory(prefix="wordwood-bench-") as scratch:
        spark = session(cpus, scratch)
        # A small table first, so that starting up is not charged to the first query.
        small = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
        word_counts(small).write.format("noop").mode("overwrite").save()
        seconds = {}
        for name in names or QUERIES:
            times = []
            for _ in range(repeats):
                started = time.monotonic()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.monotonic() - started)
            seconds[name] = round(min(times), 3)
            print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
        spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps(
        {"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}
    ))


if __name__ == "__main__":
    main(sys.argv[1:])
