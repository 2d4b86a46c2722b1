"""Experiments at growing sizes as run logs, and the journal that lets one go on after a stop."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordwood.operators.runlog import RUN_LOG_SCHEMA
from wordwood.operators.text import token_total, word_counts
from wordwood.operators.upscale import replicate
from wordwood.sources.datasets import copy_dataset, dataset_exists, dataset_path, read_lines, write_dataset, write_lines
from wordwood.sources.generate import gen_classification, gen_text
from wordwood.sources.scratch import scratch_path

# Fixed value: files of an uploaded dataset.
UPLOAD_FILES = 4

# A run log with what was counted, or what went wrong.
COUNT_LOG = T.StructType(
    [*RUN_LOG_SCHEMA.fields, T.StructField("counted", T.LongType()), T.StructField("error", T.StringType())]
)


class Journal:
    """An append-only table of finished runs at a path.

    A run is known by its ``keys``. The journal grows by one file with each run, written whole or not
    at all, so what a killed application has finished is there for the next one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = T.StructType([*schema.fields, T.StructField("written", T.DoubleType())])
        self.columns = schema.names

    def append(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame([(*r, time.time()) for r in rows], self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)

    def log(self) -> DataFrame:
        """The last entry of each run. A run that failed and then went well counts as well."""
        if not dataset_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema).drop("written")
        last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("written")))
        rows = self.spark.read.schema(self.schema).parquet(self.path).withColumn("last", last)
        return rows.where("last = 1").select(*self.columns)

    def finished(self, retry_failed: bool = False) -> dict[tuple, tuple]:
        """The runs that need not be done again, by their keys; one row per run of an experiment."""
        rows = [r for r in self.log().collect() if r["ok"] or not retry_failed]
        return {tuple(r[k] for k in self.keys): tuple(r) for r in rows}


def timed_run(app: str, size: int, stage: str, cores: int, run: Callable[[], int | None]) -> tuple:
    """One row of ``COUNT_LOG``: what ``run`` returned and how long it took, or that it failed."""
    started = time.monotonic()
    try:
        counted = run()
    except (PySparkException, Py4JJavaError, ValueError) as e:
        return (app, "spark", cores, size, stage, None, False, None, str(e).split("\n", 1)[0])
    return (app, "spark", cores, size, stage, time.monotonic() - started, True, counted, None)


def text_sweep(
    spark: SparkSession,
    root: str,
    sizes_mb: Iterable[int],
    splits: int = 24,
    journal: str | None = None,
    build: Callable[[int], DataFrame] | None = None,
) -> DataFrame:
    """Count the tokens of text files of growing size, in MB: a run log with the counts.

    Stages are ``generate``, which writes the files of a size where they are missing, and ``count``, a
    scan in about ``splits`` tasks. With a ``journal`` finished runs are not done again.
    """
    cores = spark.sparkContext.defaultParallelism
    make = build or (lambda mb: gen_text(spark, mb))
    kept = Journal(spark, journal or scratch_path(spark, "journal"), COUNT_LOG, ["size", "stage"])
    done = kept.finished()
    for mb in sizes_mb:
        path = f"{root.rstrip('/')}/text_{mb}"

        def generate(mb=mb, path=path) -> None:
            if not dataset_exists(spark, path):
                write_lines(make(mb), path)

        def count(path=path) -> int:
            return token_total(read_lines(spark, path, splits=splits), "value").first()["tokens"]

        for stage, run in (("generate", generate), ("count", count)):
            if (mb, stage) not in done:
                kept.append([timed_run("text", mb, stage, cores, run)])
    return kept.log()


def copies_sweep(
    lines: DataFrame, factors: Iterable[int], slices: int = 24, journal: str | None = None
) -> DataFrame:
    """Count the words of lines that are repeated more and more often: a run log, its size the factor."""
    spark = lines.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kept = Journal(spark, journal or scratch_path(spark, "journal"), COUNT_LOG, ["size", "stage"])
    done = kept.finished()
    for m in factors:
        if (m, "count") in done:
            continue

        def count(m=m) -> int:
            counts = word_counts(replicate(lines, m, slices), "value")
            return counts.agg(F.sum("n")).first()[0] or 0

        kept.append([timed_run("copies", m, "count", cores, count)])
    return kept.log()


def upload_sweep(
    spark: SparkSession,
    root: str,
    sizes: Iterable[int],
    files: int = UPLOAD_FILES,
    build: Callable[[int], DataFrame] | None = None,
) -> DataFrame:
    """Make datasets and bring them to their place, each step timed: a run log with numbers of rows.

    Stages are ``generate``, the making of the rows, which go to scratch, and ``upload``, their copy
    to ``root`` in that number of files. What fails to be made is not brought anywhere.
    """
    cores = spark.sparkContext.defaultParallelism
    make = build or (lambda n: gen_classification(spark, n))
    runs = []
    for size in sizes:
        made = scratch_path(spark, "generated")
        runs.append(timed_run("upload", size, "generate", cores, lambda n=size, at=made: write_dataset(make(n), at)))

        def upload(size=size, made=made) -> int:
            return copy_dataset(spark, made, dataset_path(root, size), files).count()

        if runs[-1][6]:
            runs.append(timed_run("upload", size, "upload", cores, upload))
        else:
            runs.append((*runs[-1][:4], "upload", *runs[-1][5:]))
    return spark.createDataFrame(runs, COUNT_LOG)
