"""The experiments at growing sizes: text by file size, text by factor, forests by rows.

Each run becomes a row of a run log; the tables at the end are made from it by the run-log
operators. The text experiments also time a plain Python loop over the same lines, as the
single-machine side of the comparison. Data goes to a scratch folder.

    python ladder.py --text-mb 50 200 --factors 10 100 --rows 100000 500000
"""

from __future__ import annotations

import argparse
import contextlib
import glob
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bench import session
from wordwood import operators as op
from wordwood import sources as src
from wordwood.functions import size_label
from wordwood.sources.datasets import FACTORS, TABLE_SIZES, TEXT_SIZES_MB
from wordwood.sources.generate import MB, PHRASE, PHRASES_PER_LONG_LINE

SLICES = 24


class Log:
    """Collects rows of a run log."""

    def __init__(self, cores: int):
        self.cores, self.rows = cores, []

    @contextlib.contextmanager
    def run(self, app: str, engine: str, size: int, stage: str):
        started = time.monotonic()
        yield
        seconds = round(time.monotonic() - started, 3)
        cores = 1 if engine == "local" else self.cores
        self.rows.append((app, engine, cores, size, stage, seconds, True))
        print(f"{app} {engine} {size} {stage}: {seconds} s", flush=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, op.RUN_LOG_SCHEMA)


def text_by_size(spark: SparkSession, root: str, log: Log, sizes: list[int]) -> None:
    """Token total over text files."""
    for mb in sizes:
        path = src.dataset_path(root, mb, "MB.txt")
        with log.run("token_total", "spark", mb, "generate"):
            src.write_lines(src.gen_text(spark, mb), path)
        with log.run("token_total", "spark", mb, "count"):
            total = op.token_total(src.read_lines(spark, path), "value").first()["tokens"]
        with log.run("token_total", "local", mb, "count"):
            plain = 0
            for part in glob.glob(f"{path}/part-*"):
                with open(part, encoding="utf-8") as f:
                    plain += sum(len(line.split()) for line in f)
        assert total == plain == src.text_line_count(mb * MB) * 1100


def text_by_factor(spark: SparkSession, log: Log, factors: list[int]) -> None:
    """Word counts over one long line, repeated."""
    line = PHRASE * PHRASES_PER_LONG_LINE
    base = src.lines_df(spark, [line], 1)
    for m in factors:
        with log.run("upscaled_word_count", "spark", m, "count"):
            counts = op.word_counts(op.replicate(base, m, SLICES), "value").collect()
        with log.run("upscaled_word_count", "local", m, "count"):
            plain: dict[str, int] = {}
            for _ in range(m):
                for word in line.split():
                    plain[word] = plain.get(word, 0) + 1
        assert {r["word"]: r["n"] for r in counts} == plain


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--text-mb", type=int, nargs="*", default=TEXT_SIZES_MB)
    parser.add_argument("--factors", type=int, nargs="*", default=FACTORS)
    parser.add_argument("--rows", type=int, nargs="*", default=TABLE_SIZES)
    parser.add_argument("--trees", type=int, nargs="*", default=[20])
    args = parser.parse_args()
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    with tempfile.TemporaryDirectory(prefix="wordwood-ladder-") as root:
        spark = session(cpus, root)
        log = Log(int(cpus))
        text_by_size(spark, root, log, args.text_mb)
        text_by_factor(spark, log, args.factors)
        sweep = op.forest_sweep(spark, f"{root}/tables", args.rows, args.trees)
        runs = log.frame(spark)
        for app in ("token_total", "upscaled_word_count"):
            print(f"{app}: seconds by size (MB or factor)")
            done = runs.where((F.col("app") == app) & (F.col("stage") == "count"))
            local, cluster = (done.where(F.col("engine") == e) for e in ("local", "spark"))
            op.speedup(local, cluster).orderBy("size").show(100)
        print("text files: seconds per stage by MB")
        files = runs.where("app = 'token_total' AND engine = 'spark'")
        op.stage_summary(files, ["generate", "count"]).orderBy("size").show(100)
        print("forests")
        label = size_label(F.col("size")).alias("label")
        sweep.select(label, "stage", "trees", "seconds", "accuracy_pct", "ok").show(100)
        spark.stop()


if __name__ == "__main__":
    main()
