"""Names and policies derived from a dataset's size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File counts by number of rows.
FEW_FILES, MANY_FILES, MANY_FROM = 24, 48, 5_000_000

# Rows per file above the largest fixed size (one billion rows in 48 files).
MAX_ROWS_PER_FILE = 21_000_000


def size_label(size: Column, millions: bool = True) -> Column:
    """``100K``, ``4M``; always in thousands if ``millions`` is off. Fractions are cut."""
    thousand = F.lit(1000).cast("bigint")
    k = F.concat(F.call_function("div", size, thousand).cast("string"), F.lit("K"))
    if not millions:
        return k
    million = F.lit(1_000_000).cast("bigint")
    m = F.concat(F.call_function("div", size, million).cast("string"), F.lit("M"))
    return F.when(size < million, k).otherwise(m)


def files_for(size: int) -> int:
    """Number of files to write a dataset of ``size`` rows to."""
    if size < MANY_FROM:
        return FEW_FILES
    return max(MANY_FILES, -(-size // MAX_ROWS_PER_FILE))
