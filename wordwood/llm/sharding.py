"""Sharding by a weighted hash tree: region, then rack, then shard.

At each level a row draws a number for every child of its node: minus the logarithm of a uniform
hash of row and child, over the child's weight. The smallest draw wins, so a child gets rows in
proportion to its weight, and a change of one weight moves rows only into or out of that child.
Weights of inner nodes are sums, so a change at one shard shows on the path to it and nowhere
else: rows outside the regions, racks and shards on that path stay where they are, unless they
move into the path or out of it.

Whoever wants a new shard to receive rows only into itself adds it in a region of its own: no
weight of an old node changes then. :func:`grown` does so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordwood.llm.common import BUCKET_DIGITS, blocks_of_copies, shown, written

# Region, rack, shard, weight.
Leaf = tuple[str, str, int, float]

# Two regions of two racks of two shards.
EIGHT: list[Leaf] = [(f"r{s // 4}", f"k{s // 2 % 2}", s, 1.0) for s in range(8)]

LEVELS = 3
HEX_DIGITS = 13


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, numbered after the last, in a region of its own."""
    shard = max(s for _, _, s, _ in tree) + 1
    return [*tree, (f"r+{shard}", "k0", shard, weight)]


def _children(tree: Sequence[Leaf]) -> dict[str, dict[str, float]]:
    """Path of each inner node: the paths of its children and their weights."""
    found: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in tree:
        if weight <= 0:
            raise ValueError(f"the weight of shard {shard} must be positive, not {weight}")
        path = ""
        for name in (region, rack, str(shard)):
            below = found.setdefault(path, {})
            path = f"{path}/{name}"
            below[path] = below.get(path, 0.0) + weight
    return found


def _uniform(row: Column, child: Column) -> Column:
    """A number strictly inside (0, 1) that belongs to a row and a child."""
    digits = F.substring(F.md5(F.concat(row, child)), 1, HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a row, an expression of its key alone. A null key is a key like any other."""
    children = _children(tree)
    row = shown(key)
    names = {
        path: F.array(
            *[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("path")) for c, w in below.items()]
        )
        for path, below in children.items()
    }
    table = F.create_map(*[x for path, below in names.items() for x in (F.lit(path), below)])

    def winner(below: Column) -> Column:
        draws = F.transform(
            below,
            lambda c: F.struct(
                (-F.ln(_uniform(row, c["path"])) / c["weight"]).alias("draw"),
                c["path"].alias("path"),
            ),
        )
        return F.array_min(draws)["path"]

    path = winner(names[""])
    for _ in range(LEVELS - 1):
        path = winner(table[path])
    return F.element_at(F.split(path, "/"), -1).cast("int")


def place(
    docs: DataFrame,
    tree: Sequence[Leaf] = EIGHT,
    next_tree: Sequence[Leaf] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Put every row into a shard and give it a slot there.

    Returns one row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size``
    is the number of UTF-8 bytes plus 1, ``slot`` numbers the rows of a shard from 0 without a
    gap, ``grown_shard`` is the shard in ``next_tree``. The law is ``key``: id and tree alone
    decide about the shard, so equal ids stay together and a retry changes nothing.

    Null text counts as empty, a null id is an id like any other. Repeated rows get slots of
    their own. An empty table gives an empty one. Other columns are not read.

    Slots come from counts per shard and range of hashes, at most 65,536 ranges per shard; each
    range is numbered by itself. Hashes cover id, size and checksum, and identical rows are
    counted before they are moved, so neither one id nor one row can fill a range.
    """
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    blocks = blocks_of_copies(rows, ["doc_id", "size", "text_crc32"])
    parts = [shown(F.col(c)) for c in ("doc_id", "size", "text_crc32", "block")]
    blocks = blocks.select(
        "*",
        shard_of(F.col("doc_id"), tree).alias("shard"),
        (shard_of(F.col("doc_id"), next_tree) if next_tree else F.lit(None).cast("int")).alias(
            "grown_shard"
        ),
        F.md5(F.concat_ws("/", *parts)).alias("random"),
    )
    # The texts are read once: what follows works on this table.
    blocks = written(blocks, "shards").withColumn(
        "bucket", F.substring("random", 1, BUCKET_DIGITS)
    )
    counts = blocks.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        "shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
    )
    inside = (
        Window.partitionBy("shard", "bucket")
        .orderBy("random", "doc_id", "size", "text_crc32", "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = blocks.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    placed = numbered.join(starts, ["shard", "bucket"]).withColumn("copy", copy)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("before") + F.col("copy")).cast("bigint").alias("slot"),
        "grown_shard",
    )
