"""What several operators of this folder share: words, digests, blocks of copies, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordwood.sources.datasets import read_dataset, write_dataset
from wordwood.sources.scratch import scratch_path

# Words are runs of anything but these six characters.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = f"[^{SPACE_CLASS}]+"

# Digits of a hexadecimal digest that name a bucket: 65,536 buckets of equal expected size.
BUCKET_DIGITS = 4

# Identical rows are counted, and made again in blocks of at most this many.
COPIES_PER_BLOCK = 10_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+")
    return F.filter(parts, lambda w: w != "")


def shown(value: Column) -> Column:
    """A value as text, null as a text that no other value has here."""
    return F.coalesce(value.cast("string"), F.lit("\x00null"))


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The same rows as a table in the shared scratch folder: lineage ends here.

    With ``folder``, a path of that scratch folder, beneath it: so tables can go together.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)
    write_dataset(df, path)
    return read_dataset(spark, path, df.schema)


def blocks_of_copies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each different row once per block of its copies: ``cols``, ``rows`` that are equal, ``block``, ``copies``.

    Copies are summed within each task before they are shuffled; one row that makes up a third
    of the table becomes many blocks, which later shuffles deal out.
    """
    counted = df.groupBy(*cols).agg(F.count("*").alias("rows"))
    last = F.call_function("div", F.col("rows") - 1, F.lit(COPIES_PER_BLOCK))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    left = F.col("rows") - F.col("block") * COPIES_PER_BLOCK
    copies = F.least(left, F.lit(COPIES_PER_BLOCK).cast("bigint"))
    return blocks.select(*cols, "rows", "block", copies.alias("copies"))


def total_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of a text column."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def fragments_for(spark: SparkSession, size: int, per_fragment: int) -> int:
    """Number of fragments such that each holds about ``per_fragment`` units of ``size``."""
    return max(1, -(-size // per_fragment))
