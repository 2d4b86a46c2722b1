"""Random numbers that depend on the row's key and a seed, never on the partitioning.

``rand(seed)`` and ``randomSplit`` change with the number and order of partitions, so a
retried or re-planned job may see other values. An md5 of the key does not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_list(key: str | Iterable[str]) -> list[str]:
    """A key given as one column name or as several."""
    return [key] if isinstance(key, str) else list(key)


def row_hash(key: str | Iterable[str], salt: object) -> Column:
    """32 hex digits of ``md5(key-salt)``.

    Of several parts each is written with its length, so parts that only join to the same text
    differ. A null is no text that a part can have.
    """
    keys = key_list(key)
    parts = [F.col(k).cast("string") for k in keys]
    if len(keys) > 1:
        parts = [F.concat_ws(":", F.length(p), p) for p in parts]
    known = [F.coalesce(F.when(F.col(k).isNotNull(), p), F.lit("\x00")) for k, p in zip(keys, parts, strict=True)]
    return F.md5(F.concat_ws("-", *known, F.lit(str(salt))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, changed where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def uniform(digest: str, word: int) -> str:
    """The ``word``-th group of 8 hex digits (0 to 3) as a number strictly inside (0, 1).

    An expression in SQL, over a column of :func:`row_hash`.
    """
    digits = f"substring({digest}, {8 * word + 1}, 8)"
    return f"((cast(conv({digits}, 16, 10) AS bigint) + 0.5D) / 4294967296.0D)"
