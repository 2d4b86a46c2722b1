"""Analysis of a run log: which stage of which run took how long.

A failed run has ``ok = false``, and its seconds count as unknown: null, never 0. So does every
figure that a failed run is part of: a sum, mean or ratio over it is null as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("app", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("cores", T.IntegerType()),
        T.StructField("size", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("ok", T.BooleanType()),
    ]
)


# How the runs of one cell become one number.
AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def mask_failed(log: DataFrame, value: str = "seconds") -> DataFrame:
    """Replace the value of failed runs by null."""
    return log.withColumn(value, F.when(F.col("ok"), F.col(value)))


def _known(value: str, agg: str, where: Column) -> Column:
    """The aggregate over the runs of a cell; null if there is none, or if one of them failed."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}, not {agg!r}")
    failed = F.count_if(where & ~F.coalesce(F.col("ok"), F.lit(False)))
    return F.when(failed == 0, AGGREGATES[agg](F.when(where, F.col(value))))


def run_matrix(
    log: DataFrame,
    row: str = "size",
    col: str = "cores",
    values: Sequence = (),
    value: str = "seconds",
    prefix: str = "",
    agg: str = "sum",
) -> DataFrame:
    """One row per ``row``, one column per entry of ``values`` and one for all other entries.

    A cell is the ``agg`` of ``value`` there; null without runs or with a failed one. Entries that
    are not listed, null among them, show in the column ``other``. Written as one aggregation
    with a condition per cell: a pivot would shuffle twice.
    """
    listed = F.coalesce(F.col(col).isin(list(values)), F.lit(False))
    cells = [
        _known(value, agg, F.coalesce(F.col(col) == v, F.lit(False))).alias(f"{prefix}{v}")
        for v in values
    ]
    return log.groupBy(row).agg(*cells, _known(value, agg, ~listed).alias(f"{prefix}other"))


def stage_summary(log: DataFrame, stages: Sequence[str], agg: str = "sum") -> DataFrame:
    """Seconds per stage, side by side, for each size."""
    return run_matrix(log, "size", "stage", stages, "seconds", agg=agg)


def speedup(
    a: DataFrame,
    b: DataFrame,
    key: str = "size",
    value: str = "seconds",
    names: tuple[str, str] = ("local", "spark"),
    agg: str = "mean",
) -> DataFrame:
    """Compare the runs of two engines: time of each, ratio and winner per key.

    An engine's time is the mean of its runs, so it may have run more often than the other; it is
    unknown if one of them failed.

    ``ratio`` is the time of the first engine over that of the second. The second one wins
    only if it is strictly faster. Without a time on both sides there is neither.
    """
    first, second = names

    def total(log: DataFrame, name: str) -> DataFrame:
        # Aggregated ahead of the join, so a key has one row per side however often it ran.
        return log.groupBy(key).agg(_known(value, agg, F.lit(True)).alias(f"{name}_{value}"))

    x, y = F.col(f"{first}_{value}"), F.col(f"{second}_{value}")
    winner = F.when(y < x, second).when(y >= x, first)
    both = total(a, first).join(total(b, second), key, "full")
    return both.select(key, x, y, F.try_divide(x, y).alias("ratio"), winner.alias("winner"))
