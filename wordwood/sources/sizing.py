"""How many bytes a table has, and how many files of a size it makes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordwood.sources.scratch import scratch_path

# Bytes of values whose type tells their size; others are measured, or count as LARGE.
FIXED = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}
LARGE = 16

# Rows that tell how far a table shrinks in its files make up about so many bytes.
PROBE_BYTES = 8 << 20


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory; 0 for null."""
    if type(kind) in FIXED:
        return F.when(value.isNotNull(), F.lit(FIXED[type(kind)])).otherwise(0).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("bigint")
    elif isinstance(kind, T.ArrayType):
        size = _elements(value, kind.elementType)
    elif isinstance(kind, T.MapType):
        size = _elements(F.map_keys(value), kind.keyType) + _elements(F.map_values(value), kind.valueType)
    elif isinstance(kind, T.StructType):
        parts = [value_bytes(value[f.name], f.dataType) for f in kind]
        size = sum(parts, F.lit(0).cast("bigint"))
    else:
        size = F.when(value.isNotNull(), F.lit(LARGE).cast("bigint"))
    return F.coalesce(size, F.lit(0).cast("bigint"))


def _elements(values: Column, kind: T.DataType) -> Column:
    if type(kind) in FIXED:
        return F.size(values).cast("bigint") * FIXED[type(kind)]
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda n, x: n + value_bytes(x, kind))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row of ``df`` in memory."""
    return sum((value_bytes(df[f.name], f.dataType) for f in df.schema), F.lit(0).cast("bigint"))


def table_bytes(df: DataFrame) -> tuple[int, int]:
    """Rows of a table and their bytes in memory: one aggregation."""
    found = df.agg(F.count("*").alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return found["rows"], found["bytes"] or 0


def stored_sizes(spark: SparkSession, path: str) -> list[int]:
    """Bytes of each file at a path, a pattern or below a folder, by their listing; hidden ones left out."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    sizes, todo = [], list(fs.globStatus(at) or [])
    while todo:
        status = todo.pop()
        if status.isFile():
            sizes.append(status.getLen())
        else:
            found = fs.listStatus(status.getPath())
            todo += [f for f in found if not f.getPath().getName().startswith(("_", "."))]
    return sizes


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path, a pattern or below a folder."""
    return sum(stored_sizes(spark, path))


def split_bytes(sizes: list[int], splits: int) -> int:
    """The smallest bytes of a split at which files of these sizes make at most so many.

    Where there are more files than splits, small ones are read together, and an even share is enough.
    """
    low, high = -(-max(sum(sizes), 1) // splits), max([1, *sizes])
    if len(sizes) > splits:
        return low
    while low < high:
        middle = (low + high) // 2
        if sum(-(-s // middle) for s in sizes) <= splits:
            high = middle
        else:
            low = middle + 1
    return low


def files_of(df: DataFrame, file_bytes: int) -> int:
    """Parquet files of about ``file_bytes`` that a table makes; see :func:`files_and_rows`."""
    return files_and_rows(df, file_bytes)[0]


def files_and_rows(df: DataFrame, file_bytes: int) -> tuple[int, int]:
    """Parquet files of about ``file_bytes`` that a table makes, and its rows.

    Its bytes in memory are summed up in a pass of their own; how far they shrink in a file is seen from
    some rows, which are written to scratch.
    """
    if file_bytes < 1:
        raise ValueError(f"file_bytes must be positive, but is {file_bytes}")
    rows, size = table_bytes(df)
    if not rows:
        return 1, 0
    spark = df.sparkSession
    path = scratch_path(spark, "probe")
    few = df.limit(max(1, min(rows, PROBE_BYTES * rows // max(size, 1))))
    few.write.parquet(path)
    _, seen = table_bytes(spark.read.schema(df.schema).parquet(path))
    shrunk = stored_bytes(spark, path) / max(seen, 1)
    return max(1, math.ceil(size * shrunk / file_bytes)), rows
