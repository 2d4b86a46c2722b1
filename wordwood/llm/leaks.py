"""Benchmark decontamination: short test items inside long documents.

Containment of an item in a document is the share of the item's shingles that the document has.
Jaccard sketches of whole documents cannot see it, as a long document dwarfs an item; so the
sketch is one of the item alone, and the whole document is held against it. Items are
partitioned by size. A partition has one sketch length, long enough that a document with the
wanted share of any of its items must have one of the sketch's hashes: an item of q shingles of
which k must be found may lack q - k, so of its q - k + 1 first hashes one is there, in whatever order they
are. The order is that of the number of items that have a hash, then of the hash, so what many items begin
with is in none of their sketches if they have anything of their own. The search
misses nothing. Candidates are pairs of a document and an item, and only these are verified, by counting the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordwood.functions.hashing import fresh
from wordwood.llm.common import lower_ascii, words, written

# Words of a shingle, and the least containment in percent.
WIDTH = 5
LEAST_PCT = 80

# Sketches of up to so many hashes (a few MB) are sent to every task; larger ones are joined by
# a shuffle.
BROADCAST_HASHES = 200_000


def _shingles(terms: Column, width: Column, make) -> Column:
    """``make`` of every run of ``width`` words; an empty array where there are fewer words."""
    size = F.size(terms)
    runs = F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: make(F.slice(terms, i, width)))
    return F.when((width > 0) & (size >= width), runs)


def _as_text(run: Column) -> Column:
    return F.array_join(run, " ")


def item_shingles(items: DataFrame, key: str, text: str) -> DataFrame:
    """One row per item: ``item_id, item_md5, width, shingles, hashes, sketch_size``.

    Items of fewer words than ``WIDTH`` are one shingle of all their words.
    """
    terms = words(lower_ascii(F.col(text)))
    read = items.select(F.col(key).alias("item_id"), terms.alias("terms")).distinct()
    read = read.withColumn("width", F.least(F.size("terms"), F.lit(WIDTH))).where("width > 0")
    made = read.select(
        "item_id",
        F.md5(F.array_join("terms", " ").cast("binary")).alias("item_md5"),
        "width",
        F.array_distinct(_shingles(F.col("terms"), F.col("width"), _as_text)).alias("shingles"),
        F.array_sort(
            F.array_distinct(_shingles(F.col("terms"), F.col("width"), F.xxhash64))
        ).alias("hashes"),
    )
    # Partitions by size: up to 1, 2, 4, 8 ... shingles. Each has the sketch of its largest size.
    size = F.size("shingles")
    largest = F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")))).cast("int")
    needed = F.ceil(largest * (LEAST_PCT / 100)).cast("int")
    return made.withColumn("sketch_size", F.least(largest - needed + 1, F.size("hashes")))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """All pairs of a document and an item of which it has at least ``LEAST_PCT`` % of the shingles.

    Returns ``doc_id, text_md5, item_id, shared, n_shingles``, one row per different document
    (id and text) and different item. Words are compared without the case of A-Z.

    Null and empty texts, on either side, are in no pair. Null ids are ids, repeated rows count
    once, other columns are not read. Empty tables give an empty result. Documents of any length
    are searched whole.
    """
    read = written(item_shingles(items, item_key, item_text), "items")
    of_items = read.select("item_id", "item_md5", "sketch_size", F.explode("hashes").alias("hash"))
    rarity = of_items.groupBy("hash").agg(F.count("*").alias("n"))
    ranked = of_items.join(rarity, "hash").groupBy("item_id", "item_md5", "sketch_size").agg(
        F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("ranked")
    )
    first = F.slice("ranked", 1, F.col("sketch_size"))
    sketch = ranked.select("item_id", "item_md5", F.explode(first).alias("x"))
    sketch = sketch.select("item_id", "item_md5", F.col("x.hash").alias("hash"))
    sizes = read.agg(
        F.sum("sketch_size").alias("hashes"), F.array_sort(F.collect_set("width")).alias("widths")
    ).first()
    if (sizes["hashes"] or 0) <= BROADCAST_HASHES:
        sketch = F.broadcast(sketch)

    whole = docs.select(
        F.col(key).alias("doc_id"),
        F.md5(F.col(text).cast("binary")).alias("text_md5"),
        F.col(text).alias("text"),
    )
    terms = whole.select("doc_id", "text_md5", words(lower_ascii(F.col("text"))).alias("terms"))

    def all_shingles(make) -> Column:
        # One width, but for items of fewer words than that; there are WIDTH of them at most.
        return F.concat(
            *[
                F.coalesce(
                    _shingles(F.col("terms"), F.lit(w), make),
                    F.array().cast("array<bigint>" if make is F.xxhash64 else "array<string>"),
                )
                for w in sizes["widths"] or [WIDTH]
            ]
        )

    hashed = terms.select("doc_id", "text_md5", F.explode(all_shingles(F.xxhash64)).alias("hash"))
    found = hashed.join(sketch, "hash").select("doc_id", "text_md5", "item_id", "item_md5").distinct()
    # As a table its size is known, so Spark sends it to the texts if it is small.
    found = written(found, "leak-candidates")

    suspects = found.select(F.col("doc_id").alias("d"), F.col("text_md5").alias("m")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_md5") == F.col("m"))
    texts = terms.join(suspects, same, "left_semi").dropDuplicates(["doc_id", "text_md5"])
    owned = texts.select(
        F.col("doc_id").alias("d"),
        F.col("text_md5").alias("m"),
        F.explode(F.array_distinct(all_shingles(_as_text))).alias("s"),
    )
    # The shingles of each item for each of its candidates: an item is looked for in no other document.
    shingles = read.select(
        F.col("item_id").alias("i"),
        F.col("item_md5").alias("im"),
        F.size("shingles").cast("bigint").alias("n_shingles"),
        "shingles",
    )
    same_item = F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_md5") == F.col("im"))
    wanted = found.join(shingles, same_item).select(
        "doc_id", "text_md5", "item_id", "item_md5", "n_shingles", F.explode("shingles").alias("shingle")
    )
    matches = wanted.join(owned, same & (F.col("shingle") == F.col("s"))).groupBy(
        "doc_id", "text_md5", "item_id", "item_md5", "n_shingles"
    ).agg(F.count("*").alias("shared"))
    enough = matches.where(F.col("shared") * 100 >= F.col("n_shingles") * LEAST_PCT)
    return enough.groupBy("doc_id", "text_md5", "item_id").agg(
        F.max(F.struct("shared", "n_shingles")).alias("best")
    ).select("doc_id", "text_md5", "item_id", "best.shared", "best.n_shingles")


def without_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    own_id, own_md5 = fresh(docs, "_leak_id", "_leak_md5")
    leaks = find_leaks(docs, items, key, text).select(
        F.col("doc_id").alias(own_id), F.col("text_md5").alias(own_md5)
    )
    leaks = written(leaks.distinct(), "leaks")
    same = docs[key].eqNullSafe(leaks[own_id]) & (
        F.md5(docs[text].cast("binary")) == leaks[own_md5]
    )
    return docs.join(leaks, same, "left_anti")
