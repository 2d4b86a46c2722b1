"""Test data made inside Spark; nothing passes through the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordwood.functions.hashing import row_hash, uniform

# The phrase, how often one line repeats it, and the sample line.
PHRASE = "Hello Spark Big Data Hadoop AI Machine Learning Python Java Scala "
PHRASES_PER_LINE = 100
PHRASES_PER_LONG_LINE = 10_000
SAMPLE_LINE = "Hello Spark Hello Big Data Python Java Hadoop Cluster AI Machine Learning"
SAMPLE_LINES = 10_000

MB = 1024 * 1024
LINE_BYTES = len(PHRASE) * PHRASES_PER_LINE + 1

# One task makes about 128 MB of text, or a few million short rows.
LINES_PER_TASK = 128 * MB // LINE_BYTES
ROWS_PER_TASK = 4_000_000


def _range(spark: SparkSession, n: int, per_task: int) -> DataFrame:
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / per_task))
    return spark.range(0, n, 1, tasks)


def add_classification(
    df: DataFrame, key: str, seed: int = 42, sep: float = 1.5, flip: float = 0.01
) -> DataFrame:
    """Give each row of a keyed table four features and a label: ``id, f0..f3, label``.

    Four Gaussian clusters on corners of a cube in ``f0..f2``; two clusters per class, laid
    out so that no single axis tells the label. ``f3`` is noise, and a share ``flip`` of the
    labels is drawn anew. All numbers come from two md5 digests of the key: each holds four
    uniforms, and Box-Muller turns a pair of uniforms into a pair of normals. The digests are
    not those that splits and permutations go by: a split by ``md5(key-seed)`` would otherwise
    be a split by the size of ``f0``.
    """
    digests = df.select(
        F.col(key).cast("bigint").alias("id"),
        row_hash(key, f"{seed}-features").alias("_h"),
        row_hash(key, f"{seed}-label").alias("_l"),
    )
    # One step per select: Catalyst keeps a costly column that is used twice as a column.
    polar = digests.selectExpr(
        "id",
        "pmod(id, 4) AS cluster",
        f"sqrt(-2.0D * ln({uniform('_h', 0)})) AS r0",
        f"2.0D * pi() * {uniform('_h', 1)} AS a0",
        f"sqrt(-2.0D * ln({uniform('_h', 2)})) AS r2",
        f"2.0D * pi() * {uniform('_h', 3)} AS a2",
        f"{uniform('_l', 0)} < {flip} AS redrawn",
        f"CASE WHEN {uniform('_l', 1)} < 0.5D THEN 0 ELSE 1 END AS drawn",
    )
    # Clusters 0..3 sit at (+,+,+), (+,-,+), (-,-,-), (-,+,+).
    return polar.selectExpr(
        "id",
        f"cast(round(r0 * cos(a0) + if(cluster IN (0, 1), {sep}D, {-sep}D), 4) AS float) AS f0",
        f"cast(round(r0 * sin(a0) + if(cluster IN (0, 3), {sep}D, {-sep}D), 4) AS float) AS f1",
        f"cast(round(r2 * cos(a2) + if(cluster = 2, {-sep}D, {sep}D), 4) AS float) AS f2",
        "cast(round(r2 * sin(a2), 4) AS float) AS f3",
        "cast(if(redrawn, drawn, cluster % 2) AS int) AS label",
    )


def gen_classification(
    spark: SparkSession, n: int, seed: int = 42, sep: float = 1.5, flip: float = 0.01
) -> DataFrame:
    """Synthetic classification table of ``n`` rows; see :func:`add_classification`."""
    return add_classification(_range(spark, n, ROWS_PER_TASK), "id", seed, sep, flip)


def text_line_count(target_bytes: float) -> int:
    """Lines needed to reach a size: the first line count that is not below the target."""
    return math.ceil(target_bytes / LINE_BYTES)


def text_lines(spark: SparkSession, n: int) -> DataFrame:
    """``n`` copies of the long repeated line, ``value string``."""
    line = F.repeat(F.lit(PHRASE), F.lit(PHRASES_PER_LINE))
    return _range(spark, n, LINES_PER_TASK).select(line.alias("value"))


def gen_text(spark: SparkSession, target_mb: float) -> DataFrame:
    """Lines whose text file reaches ``target_mb``."""
    return text_lines(spark, text_line_count(target_mb * MB))


def gen_sample_lines(spark: SparkSession, n: int = SAMPLE_LINES) -> DataFrame:
    """``n`` copies of the short sample line, ``value string``."""
    return _range(spark, n, ROWS_PER_TASK).select(F.lit(SAMPLE_LINE).alias("value"))


def add_sample_lines(df: DataFrame, *cols: str) -> DataFrame:
    """The sample line for each row of a table, followed by the values of ``cols``: ``value string``.

    A null value adds nothing.
    """
    return df.select(F.concat_ws(" ", F.lit(SAMPLE_LINE), *[F.col(c).cast("string") for c in cols]).alias("value"))
