"""Shuffling, splitting and previewing rows by a key that is unique.

The order is that of ``md5(key-seed)``, then the key. It belongs to the row, so it is the
same on any cluster, after any repartitioning and after any retry. A table without a unique
key gets one from :func:`wordwood.operators.number_copies`.
"""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordwood.functions.hashing import fresh, key_list, row_hash

# Buckets are the next hex digits of the hash. 16 ** 4 and 16 ** 3 bound the tables of buckets
# below, whatever the size of the data, so these may be broadcast or pass through one window.
# A permutation sorts each bucket, so it wants many; a split only counts them, and what a task
# sends on is one row per bucket, so it wants few.
DIGITS = 4
SPLIT_DIGITS = 3

# The search for a cut goes on until a bucket has at most this many keys; these are looked at.
LEAF_ROWS = 300

HASH_DIGITS = 32


def _fraction(test: float) -> Fraction:
    share = Fraction(str(test))
    if not 0 < share < 1:
        raise ValueError(f"test must lie between 0 and 1, not {test}")
    return share


def _with_part(df: DataFrame, is_test: Column) -> DataFrame:
    return df.withColumn("part", F.when(is_test, "test").otherwise("train"))


def permute(df: DataFrame, key: str | Iterable[str], seed: int = 42) -> DataFrame:
    """Random order as a column: adds ``pos``, a permutation of 1..n.

    A row's position is the number of rows in the buckets before its own, plus its rank in
    its bucket. The counts come from a scan of the key alone. The rows are shuffled once, by
    bucket, and a bucket holds about n / 65,536 of them.
    """
    keys = key_list(key)
    bucket, digest, at, start, rows = fresh(df, "_bucket", "_hash", "_rank", "_start", "_rows")
    number = F.conv(F.substring(row_hash(keys, seed), 1, DIGITS), 16, 10).cast("int")
    dealt = df.withColumn(bucket, number)
    counts = dealt.groupBy(bucket).agg(F.count("*").alias(rows))
    so_far = F.sum(rows).over(Window.orderBy(bucket))
    starts = counts.select(bucket, (so_far - F.col(rows)).alias(start))
    # The hash is made again behind the shuffle: a number is all that travels with the rows.
    hashed = dealt.repartition(bucket).withColumn(digest, row_hash(keys, seed))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy(digest, *keys))
    ranked = hashed.withColumn(at, rank).join(F.broadcast(starts), bucket)
    return ranked.select(*df.columns, (F.col(start) + F.col(at)).alias("pos"))


def hash_split(
    df: DataFrame, key: str | Iterable[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``, ``test`` or ``train``, in about the given shares. No shuffle, no job."""
    threshold = format(int(_fraction(test) * 2**32), "08x")
    return _with_part(df, F.substring(row_hash(key, seed), 1, 8) < threshold)


def _cut_hash(hashed: DataFrame, keys: list[str], share: Fraction) -> str:
    """Hash of the last test row.

    Looks for the bucket that the cut falls into and goes on inside it, some hex digits at a
    time: one aggregation of the keys per level, one row to the driver. The last bucket is as
    small whatever the size of the table.
    """
    prefix, wanted = "", None
    while True:
        inside = hashed.where(F.col("_hash").startswith(prefix)) if prefix else hashed
        bucket = F.substring("_hash", len(prefix) + 1, SPLIT_DIGITS).alias("_bucket")
        counts = inside.groupBy(bucket).agg(F.count("*").alias("_rows"))
        reached = F.sum("_rows").over(Window.orderBy("_bucket"))
        if wanted is None:
            total = F.sum("_rows").over(Window.partitionBy())
            p, q = F.lit(share.numerator), F.lit(share.denominator)
            target = F.call_function("div", total * p + q - 1, q)
        else:
            target = F.lit(wanted)
        running = counts.select(
            "_bucket", "_rows", reached.alias("_reached"), target.alias("_target")
        )
        found = running.where("_reached >= _target").orderBy("_bucket").first()
        if found is None:
            raise ValueError("cannot split an empty table")
        prefix += found["_bucket"]
        wanted = found["_target"] - (found["_reached"] - found["_rows"])
        if found["_rows"] <= LEAF_ROWS:
            break
        if len(prefix) == HASH_DIGITS:
            raise ValueError(f"{keys} is not a unique key")
    leaf = hashed.where(F.col("_hash").startswith(prefix)).orderBy("_hash")
    at_cut = leaf.offset(wanted - 1).limit(2).collect()
    if len(at_cut) == 2 and at_cut[0]["_hash"] == at_cut[1]["_hash"]:
        raise ValueError(f"{keys} is not a unique key")
    return at_cut[0]["_hash"]


def exact_split(
    df: DataFrame, key: str | Iterable[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part`` such that exactly ``ceil(test * n)`` rows are in ``test``.

    These are the first rows of :func:`permute`. Only the hash at the cut is looked up, ahead
    of time; the split itself is then a comparison, and the rows are not shuffled.
    """
    keys = key_list(key)
    digest = row_hash(keys, seed)
    cut = _cut_hash(df.select(digest.alias("_hash")), keys, _fraction(test))
    return _with_part(df, digest <= cut)


def preview(df: DataFrame, key: str | Iterable[str] | None = None, n: int = 3) -> DataFrame:
    """The first ``n`` rows by key. Without a key any ``n``, which need not read all rows."""
    return df.orderBy(*key_list(key)).limit(n) if key is not None else df.limit(n)
