"""Making a small table large: repeating rows, without joins.

Copies come from exploding a number range inside each row. The range is cut into blocks, and
the blocks are spread over tasks before the copies are made, so one row with a billion
copies is the work of many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordwood.functions.hashing import fresh
from wordwood.sources.datasets import read_dataset, write_dataset
from wordwood.sources.scratch import scratch_path
from wordwood.sources.sizing import row_bytes, table_bytes

# Copies that one row makes at a time.
BLOCK = 10_000

# What one task should make, in rows and in bytes of memory, and the most tasks that are asked for.
ROWS_PER_TASK = 1_000_000
BYTES_PER_TASK = 16 << 20
MAX_TASKS = 20_000

# Copies of one row are dealt out in pieces of about so many bytes; with a number of slices, a slice gets
# at least so many pieces. A row weighs its bytes and some more, as an empty one is work too.
PIECE_BYTES = 1 << 20
PIECES_PER_SLICE = 8
LEAST_WEIGHT = 16

# monotonically_increasing_id() holds the partition above this bit, the row number below.
PARTITION_BIT = 33


def dense_index(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """Number the rows 0..n-1 in the order of a unique key.

    The table is sorted over all tasks and written to scratch with its position in each sorted
    part; the sizes of the parts, one row per part, then give the offsets.
    """
    spark = df.sparkSession
    at, part, rows, offset = fresh(df, "_at", "_part", "_rows", "_offset")
    path = scratch_path(spark, "dense-index")
    write_dataset(df.orderBy(key).withColumn(at, F.monotonically_increasing_id()), path)
    done = read_dataset(spark, path).withColumn(part, F.shiftright(at, PARTITION_BIT))
    sizes = done.groupBy(part).agg(F.count("*").alias(rows))
    so_far = F.sum(rows).over(Window.orderBy(part))
    offsets = sizes.select(part, (so_far - F.col(rows)).alias(offset))
    within = F.col(at).bitwiseAND(F.lit((1 << PARTITION_BIT) - 1))
    numbered = done.join(F.broadcast(offsets), part)
    return numbered.select(*df.columns, (F.col(offset) + within).alias(name))


def _copied(df: DataFrame, copies: Column, name: str, tasks: int | None) -> DataFrame:
    """Every row ``copies`` times, numbered from 0 in column ``name``; none at 0 copies.

    With ``tasks``, the blocks of copies are dealt out to that many tasks.
    """
    wanted, block = fresh(df, "_copies", "_block")
    last_block = F.call_function("div", F.col(wanted) - 1, F.lit(BLOCK))
    some = df.withColumn(wanted, copies).where(F.col(wanted) > 0)
    blocks = some.withColumn(block, F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)))
    if tasks:
        blocks = blocks.repartition(tasks)
    first = F.col(block) * BLOCK
    last = F.least(first + BLOCK, F.col(wanted)) - 1
    return blocks.select(*df.columns, F.explode(F.sequence(first, last)).alias(name))


def _tasks(rows: int, size: int) -> int:
    """Tasks to make so many rows of so many bytes."""
    return min(MAX_TASKS, max(1, math.ceil(rows / ROWS_PER_TASK), math.ceil(size / BYTES_PER_TASK)))


def tile(df: DataFrame, key: str, size: int, name: str = "id") -> DataFrame:
    """Repeat a table, in the order of its unique key, up to exactly ``size`` rows.

    Adds ``name``, 0..size-1: row ``i`` of a table of ``n`` rows is found at ``i``, ``n + i``,
    ``2n + i`` and so on.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already: choose another name")
    n, held = table_bytes(df)
    if n == 0:
        raise ValueError("cannot tile an empty table")
    index, copy = fresh(df, "_i", "_copy")
    base = dense_index(df, key, index).where(F.col(index) < size)
    copies = F.call_function("div", F.lit(size - 1) - F.col(index), F.lit(n)) + 1
    copied = _copied(base, copies, copy, _tasks(size, held * size // n))
    return copied.select((F.col(copy) * n + F.col(index)).alias(name), *df.columns)


def number_copies(df: DataFrame, name: str = "copy") -> DataFrame:
    """Tell identical rows apart: adds a number from 0, so that all columns are a unique key.

    For tables without a key, ahead of the operators that need one. Identical rows are counted
    before the shuffle and made again after it, so no task ever holds a group of copies, be it
    a third of the table. The counted rows are written to scratch: every pass over the result
    reads them, and none counts them again.
    """
    (rows,) = fresh(df, "_rows")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "counted")
    counted = df.groupBy(*df.columns).agg(F.count("*").alias(rows))
    write_dataset(counted, path)
    counted = read_dataset(spark, path, counted.schema)
    # Groups of one block are made where they are; only blocks of larger ones are dealt out.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = _copied(counted.where(F.col(rows) <= BLOCK), F.col(rows), name, None)
    many = _copied(counted.where(F.col(rows) > BLOCK), F.col(rows), name, tasks)
    return few.unionAll(many).drop(rows)


def replicate(df: DataFrame, m: int, slices: int | None = None) -> DataFrame:
    """Every row ``m`` times; none at 0.

    The work is what the copies weigh, not where the rows are: the bytes of the rows, times ``m``, say how many
    tasks make the copies, and the rows are dealt out over these before they are copied, so each is
    moved once, or once for each piece of its copies if it is long. A table whose copies
    one task can make stays where it is. With ``slices`` that many tasks share the copies: of few rows those of
    every row, while of many rows each is moved once, as above.
    """
    if m < 0:
        raise ValueError(f"m must not be negative, but is {m}")
    if m == 0:
        return df.where(F.lit(False))
    copy, share, own = fresh(df, "_copy", "_share", "_own")
    rows, size = table_bytes(df)
    weight, tasks, piece = row_bytes(df) * m, slices or _tasks(rows * m, size * m), PIECE_BYTES
    if slices:
        weight = weight + LEAST_WEIGHT * m
        piece = max(1, (size + LEAST_WEIGHT * rows) * m // (slices * PIECES_PER_SLICE))
    elif tasks == 1:
        return _copied(df, F.lit(m).cast("bigint"), copy, None).drop(copy)
    most = min(m, slices) if slices else m
    heavy = F.ceil(weight / F.lit(piece))
    pieces = F.greatest(F.lit(1), F.least(F.lit(most), heavy)).cast("int")
    dealt = df.withColumn(own, pieces)
    dealt = dealt.withColumn(share, F.explode(F.sequence(F.lit(1), F.col(own)))).repartition(tasks)
    each = F.call_function("div", F.lit(m), F.col(own))
    rest = F.col(share) <= F.lit(m) % F.col(own)
    return _copied(dealt, each + F.when(rest, 1).otherwise(0), copy, None).select(*df.columns)
