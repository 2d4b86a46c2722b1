"""Mixing sources to target weights: an exact budget of words for each source.

Every document gets a random key, a digest of its id and text. Within each source the documents
are sorted by that key and their sizes summed up from the front; the budget of the source cuts
this order at one place. Budgets above the size of a source repeat whole epochs first.

The sort is a range sort without sampling: keys are uniform, so their leading digits are ranges
of equal expected size. The sizes of the ranges, summed over, tell each range where it starts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordwood.functions.hashing import fresh
from wordwood.llm.common import BUCKET_DIGITS, COPIES_PER_BLOCK, WORD, blocks_of_copies, shown, written

# Weights of the sources in order, share of all words, most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int):
    """Words to take from each source: ``source, source_size, target``.

    ``sizes`` has one row per source (``source, source_size``), so this is a small table and
    passes through one window. Sources weigh ``weights`` in their order, null last, repeating.
    They share ``share`` times all words; none gets more than ``epochs`` times its own size, and
    what that leaves over goes to the others by weight. Sorted by size per weight, the sources
    that reach their bound come first; the level of the others is a quotient of running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = sizes.select("source", "source_size", F.get(cycle, place).alias("weight"))
    weighed = weighed.withColumn("bound", F.col("source_size") * float(epochs))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    fuller = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("source_size").over(fuller), F.lit(0)) * float(epochs)
    gone = F.coalesce(F.sum("weight").over(fuller), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * share - spent) / (
        F.sum("weight").over(everything) - gone
    )
    levels = weighed.select("*", level.alias("level"), F.row_number().over(by_fill).alias("fill"))
    # The first source that stays below its bound gives the level of all that follow.
    below = F.when(F.col("bound") > F.col("level") * F.col("weight"), F.struct("fill", "level"))
    levels = levels.withColumn("level", F.min(below).over(everything)["level"])
    target = F.least("bound", F.coalesce(F.col("level") * F.col("weight"), F.col("bound")))
    return levels.select("source", "source_size", target.alias("target"))


def _random(key: Column, text_md5: Column, block: Column, seed: int) -> Column:
    """The place of a document in its source: a digest, the same in every run."""
    return F.md5(F.concat_ws("/", shown(key), shown(text_md5), shown(block), F.lit(str(seed))))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = 42,
    whole: bool = False,
) -> DataFrame:
    """What the mix takes of each document.

    Returns one row per row of ``docs``: ``doc_id, source, text_md5, size, source_size, target,
    taken, times, rounds, random, rows``. ``size`` is the number of words. ``taken`` counts words, repeats included:
    whole epochs, and a last one up to the exact budget, so one document of a source is cut
    inside. With ``whole`` documents stay whole: the one at the cut is taken if at least half
    of it lies within the budget. ``times`` is how often the document occurs, in part or whole, ``rounds`` of these in
    epochs of the whole source; ``random`` is its key, ``rows`` how many rows are equal to it.

    Null text has no words; null sources are one source, the last; null ids are ids. Repeated
    rows are documents of their own, next to each other in the order. An empty table gives an
    empty one. Other columns are not read. Rows with equal id and text may change places.
    """
    sized = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.md5(F.col(text).cast("binary")).alias("text_md5"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    blocks = blocks_of_copies(sized, ["doc_id", "source", "text_md5", "size"])
    random = _random(F.col("doc_id"), F.col("text_md5"), F.col("block"), seed)
    blocks = blocks.withColumn("random", random)
    # The texts are read once: what follows works on this table.
    blocks = written(blocks, "mix")
    blocks = blocks.withColumn("bucket", F.substring("random", 1, BUCKET_DIGITS))

    buckets = blocks.groupBy("source", "bucket").agg(
        F.sum(F.col("size") * F.col("copies")).alias("bucket_size")
    )
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = buckets.select(
        "source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("start")
    )
    targets = source_targets(sizes, weights, share, epochs)
    cuts = starts.join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")

    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("random", "doc_id", "text_md5", "block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    placed = blocks.withColumn("before", before)
    cuts = cuts.withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    joined = placed.join(
        cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
    )
    # Copies of one block follow each other.
    rows = joined.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    at = F.col("start") + F.col("before") + F.col("copy") * F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.coalesce(F.try_divide(budget, F.col("source_size")).cast("bigint"), F.lit(0))
    rows = rows.select("*", budget.alias("budget"), rounds.alias("rounds"))
    rest = F.col("budget") - F.col("rounds") * F.col("source_size") - at
    rows = rows.withColumn("rest", rest)
    if whole:
        more = (F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size"))
        last = F.when(more, F.col("size")).otherwise(0)
    else:
        more = F.col("rest") > 0
        last = F.greatest(F.lit(0), F.least("rest", "size"))
    taken = F.col("rounds") * F.col("size") + last
    return rows.select(
        "doc_id",
        "source",
        "text_md5",
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
        (F.col("rounds") + more.cast("int")).cast("int").alias("times"),
        F.col("rounds").cast("int").alias("rounds"),
        "random",
        "rows",
    )


def mixed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 42,
    **how,
) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it, all columns.

    Documents stay whole. In the order of the mix what is taken ends at one key per source, so
    these keys are all that the documents are compared to, and no text is moved. Rows that are
    there several times, equal in id, source and text, share one key: what the mix takes of them all is shared out
    among those that differ in other columns, by how often each is there.

    Nulls and columns of any name are as any others; an empty table gives an empty one.
    """
    plan = written(mix(docs, key, source, text, seed=seed, whole=True, **how), "mix-plan")
    rounds, last, times, own_id, own_source, own_md5, copy, row = fresh(
        docs, "_rounds", "_last", "_times", "_id", "_source", "_md5", "_copy", "_row"
    )
    single = plan.where("rows = 1").groupBy("source").agg(
        F.min("rounds").alias(rounds),
        F.max(F.when(F.col("times") > F.col("rounds"), F.col("random"))).alias(last),
    )
    single = written(single.withColumnRenamed("source", own_source), "mix-cuts")
    several = plan.where("rows > 1").groupBy("doc_id", "source", "text_md5").agg(
        F.sum("times").alias(times)
    )
    several = written(several.toDF(own_id, own_source, own_md5, times), "mix-several")
    md5 = F.md5(docs[text].cast("binary"))

    def same(table: DataFrame):
        return (
            docs[key].eqNullSafe(table[own_id])
            & docs[source].eqNullSafe(table[own_source])
            & md5.eqNullSafe(table[own_md5])
        )

    alone = docs.join(several, same(several), "left_anti")
    cut = alone.join(single, alone[source].eqNullSafe(single[own_source]))
    inside = F.coalesce(_random(F.col(key), md5, F.lit(0), seed) <= F.col(last), F.lit(False))
    cut = cut.withColumn(times, (F.col(rounds) + inside.cast("int")).cast("bigint"))

    # Of the others each different row once, with the number of its copies summed within tasks.
    whole = F.struct(*[docs[c] for c in docs.columns])
    joined = docs.join(several, same(several))
    kinds = joined.groupBy(own_id, own_source, own_md5, times, F.md5(F.to_json(whole)).alias(copy)).agg(
        F.count("*").alias(rounds), F.first(whole).alias(row)
    )
    group = Window.partitionBy(own_id, own_source, own_md5)
    until = F.sum(rounds).over(group.orderBy(copy))
    total = F.sum(rounds).over(group)
    kinds = kinds.select(row, times, until.alias(last), F.col(rounds), total.alias(own_id))

    def share(rows: Column) -> Column:
        return F.call_function("div", F.col(times) * rows, F.col(own_id))

    taken = share(F.col(last)) - share(F.col(last) - F.col(rounds))
    kinds = kinds.select(taken.cast("bigint").alias(times), f"{row}.*")
    taken = cut.select(*docs.columns, times).unionAll(kinds.select(*docs.columns, times))
    # Copies in blocks: none makes a long list, and blocks of one row are the work of many tasks.
    blocks = F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col(times) - 1, F.lit(COPIES_PER_BLOCK)))
    some = taken.where(F.col(times) > 0)
    few = some.where(F.col(times) <= COPIES_PER_BLOCK).withColumn(last, F.col(times))
    many = some.where(F.col(times) > COPIES_PER_BLOCK).withColumn(copy, F.explode(blocks))
    left = F.col(times) - F.col(copy) * COPIES_PER_BLOCK
    many = many.withColumn(last, F.least(left, F.lit(COPIES_PER_BLOCK).cast("bigint"))).drop(copy)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = few.unionAll(many.select(few.columns).repartition(tasks))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(last)))
    return made.withColumn(copy, copies).select(*docs.columns)
