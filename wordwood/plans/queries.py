"""Each operator as a query over whole tables: ``(spark, sf_dir) -> DataFrame``.

Sizes that an operator needs (rows to tile to, lines to generate) are taken from the tables,
so the work of every query grows with them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood import sources as src
from wordwood.functions import files_for, size_label
from wordwood.plans.inspect import final_plan
from wordwood.sources.datasets import CORE_LEVELS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

UPSCALE_FACTOR = 10
SLICES = 24
COPY_BYTES = 64 << 20
SMALL_FILE = 128 << 10
STAGES = ["generate", "upload", "train"]
DIMENSIONS = 64


def query(fn: Query) -> Query:
    """Register a query under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return src.read_dataset(spark, f"{sf_dir}/{name}.parquet")


def synthetic(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Synthetic features for each row of a table."""
    return src.add_classification(table(spark, sf_dir, name).select(key), key)


# Text


@query
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.word_counts(table(spark, sf_dir, "documents"))


@query
def word_count_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.word_counts(op.to_lines(table(spark, sf_dir, "documents")), "value", "space")


@query
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.token_total(table(spark, sf_dir, "documents"), by=("lang",))


@query
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distinct_words(table(spark, sf_dir, "documents"), by=("lang",))


@query
def top10_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.top_words(op.word_counts(table(spark, sf_dir, "documents")), 10)


@query
def word_count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = op.word_counts(table(spark, sf_dir, "documents"))
    return op.counts_diff(documents, op.word_counts(table(spark, sf_dir, "conversations")))


@query
def word_count_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both token rules over the same texts: the check that the two counters agree."""
    documents = table(spark, sf_dir, "documents")
    by_space = op.word_counts(op.to_lines(documents), "value", "space")
    return op.counts_match(op.word_counts(documents), by_space)


@query
def text_size_mb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.text_size_mb(table(spark, sf_dir, "documents"), by=("source",))


@query
def line_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all lines to text files, scan these, and count each different line."""
    path = src.scratch_path(spark, "lines")
    src.write_lines(op.to_lines(table(spark, sf_dir, "documents")), path)
    return src.read_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query
def upscaled_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("text")
    return op.word_counts(op.replicate(documents, UPSCALE_FACTOR))


@query
def sliced_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the copies dealt out to a fixed number of slices."""
    documents = table(spark, sf_dir, "documents").select("text")
    return op.word_counts(op.replicate(documents, UPSCALE_FACTOR, SLICES))


@query
def text_token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all lines to text files and count the tokens of what is read back."""
    path = src.scratch_path(spark, "lines")
    src.write_lines(op.to_lines(table(spark, sf_dir, "documents")), path)
    return op.token_total(src.read_lines(spark, path), "value")


@query
def lines_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the nations, handed over by the driver as lines; their customers counted."""
    nations = table(spark, sf_dir, "nation").collect()
    lines = src.lines_df(spark, [f"{r['n_nationkey']} {r['n_name']}" for r in nations], SLICES)
    parts = F.split("value", " ", 2)
    named = lines.select(parts[0].cast("int").alias("c_nationkey"), parts[1].alias("name"))
    customers = table(spark, sf_dir, "customer")
    return customers.join(named, "c_nationkey").groupBy("name").agg(F.count("*").alias("n"))


@query
def pandas_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a pandas frame of features, and back: the features of each customer."""
    nations = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id",
        "n_nationkey / 2D AS f0",
        "n_regionkey * 1D AS f1",
        "length(n_name) * 1D AS f2",
        "0D AS f3",
        "n_regionkey % 2 AS label",
    )
    back = src.from_pandas(spark, nations.toPandas()).withColumnRenamed("id", "c_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = customers.join(back, "c_nationkey")
    return joined.select(F.col("c_custkey").alias("id"), *src.FEATURE_COLS, "label")


@query
def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in eight files, scanned in about 24 tasks without a shuffle."""
    path = src.scratch_path(spark, "lines")
    src.write_lines(op.to_lines(table(spark, sf_dir, "documents")), path, files=8)
    lines = src.read_lines(spark, path, splits=SLICES)
    tasks = lines.select(F.spark_partition_id().alias("task")).distinct().count()
    shuffles = len(final_plan(lines).shuffles)
    enough = F.lit(2 * SLICES // 3 <= tasks <= SLICES)
    return op.token_total(lines, "value").select(
        "tokens", enough.alias("enough"), F.lit(shuffles).alias("shuffles")
    )


@query
def text_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of a quarter and of all of the documents' size, counted; stopped and gone on with."""
    mb = op.text_size_mb(table(spark, sf_dir, "documents")).first()["size_mb"]
    sizes = [max(1, math.ceil(mb / 4)), max(2, math.ceil(mb))]
    root, journal = src.scratch_path(spark, "texts"), src.scratch_path(spark, "journal")
    op.text_sweep(spark, root, sizes[:1], SLICES, journal)
    log = op.text_sweep(spark, root, sizes, SLICES, journal)
    return log.select("size", "stage", "counted", "ok")


@query
def copies_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the conversations, repeated and counted."""
    lines = op.to_lines(table(spark, sf_dir, "conversations"))
    return op.copies_sweep(lines, [1, 3], SLICES).select("size", "stage", "counted", "ok")


@query
def pandas_plain_hand_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions as a pandas frame and back, with Arrow and without it: their nations counted."""
    regions = table(spark, sf_dir, "region").selectExpr(
        "r_regionkey AS id", "r_regionkey / 2D AS f0", "1D AS f1", "2D AS f2", "length(r_name) * 1D AS f3",
        "r_regionkey % 2 AS label",
    )
    pdf = regions.toPandas()
    both = [src.from_pandas(spark, pdf, arrow=a).withColumn("arrow", F.lit(a)) for a in (True, False)]
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "id")
    return nations.join(both[0].unionAll(both[1]), "id").groupBy("arrow", "id", "f0", "f3", "label").agg(
        F.count("*").alias("nations")
    )


@query
def plan_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often queries shuffle, in the plans that ran: once per count, and top k with one row per task more."""
    docs = table(spark, sf_dir, "documents")
    plans = {
        "word_count": op.word_counts(docs),
        "token_total": op.token_total(docs, by=("lang",)),
        "hash_split": op.hash_split(docs, "doc_id"),
        "counts_diff": op.counts_diff(
            op.word_counts(docs), op.word_counts(table(spark, sf_dir, "conversations"))
        ),
    }
    rows = [(name, len(final_plan(df).shuffles)) for name, df in plans.items()]
    return spark.createDataFrame(rows, "name string, shuffles int")


# Generated data


@query
def gen_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, as many as it takes to reach the size of all documents."""
    size_mb = op.text_size_mb(table(spark, sf_dir, "documents")).first()["size_mb"]
    text = src.gen_text(spark, size_mb)
    words = F.size(F.array_remove(F.split("value", " "), ""))
    return text.agg(
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.sum(words).alias("words"),
    )


@query
def sample_lines_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample line once per order, counted by the single-space rule."""
    n = table(spark, sf_dir, "orders").count()
    return op.word_counts(src.gen_sample_lines(spark, n), "value", "space")


@query
def gen_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic(spark, sf_dir, "orders", "o_orderkey")


@query
def tile_to_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels, tiled to as many rows as there are orders."""
    size = table(spark, sf_dir, "orders").count()
    return op.tile(table(spark, sf_dir, "labels"), "doc_id", size)


@query
def sample_lines_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample line of each order, ended by its priority, counted by the single-space rule."""
    lines = src.add_sample_lines(table(spark, sf_dir, "orders"), "o_orderpriority")
    return op.word_counts(lines, "value", "space")


@query
def generated_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated rows as there are orders: means and covariances, and whether they are as promised."""
    n = table(spark, sf_dir, "orders").count()
    found = op.distribution(src.gen_classification(spark, n))
    rows = found.collect()
    alike = not op.differences(rows)
    names = [c for c in found.columns if c.startswith(("mean_", "cov_"))]
    share = F.round(F.col("n") / F.lit(sum(r["n"] for r in rows)), 6).alias("share")
    moments = [F.round(c, 6).alias(c) for c in names]
    return found.select("label", "n", share, *moments, F.lit(alike).alias("alike"))


# Order, splits, previews


@query
def permute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.permute(table(spark, sf_dir, "orders"), "o_orderkey")


@query
def permute_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items have no unique key: number their copies, then shuffle."""
    items = op.number_copies(table(spark, sf_dir, "lineitem"))
    return op.permute(items, items.columns)


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hash_split(table(spark, sf_dir, "orders"), "o_orderkey")


@query
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exact_split(table(spark, sf_dir, "orders"), "o_orderkey")


@query
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.preview(table(spark, sf_dir, "orders"), "o_orderkey", 3)


@query
def preview_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any three orders: how many they are, and how many of them are orders."""
    orders = table(spark, sf_dir, "orders")
    few = op.preview(orders, n=3).select("o_orderkey")
    known = few.join(orders.select("o_orderkey"), "o_orderkey").agg(F.count("*").alias("known"))
    return known.select(F.lit(few.count()).cast("bigint").alias("n"), "known")


# Projection, features, datasets


@query
def scan_project_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the shape of the feature table."""
    return op.conform(
        table(spark, sf_dir, "lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.col("l_quantity").alias("f0"),
            F.col("l_extendedprice").alias("f1"),
            F.col("l_discount").alias("f2"),
            F.col("l_tax").alias("f3"),
            F.col("l_linenumber").alias("label"),
        )
    )


@query
def feature_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions of each embedding, through the assembler."""
    names = [f"f{i}" for i in range(DIMENSIONS)]
    dims = [F.col("embedding")[i].alias(name) for i, name in enumerate(names)]
    wide = table(spark, sf_dir, "embeddings").select("vec_id", *dims)
    values = vector_to_array("features")
    whole = op.assemble(wide, names)
    return whole.select("vec_id", *[values[i].alias(f"v{i}") for i in range(DIMENSIONS)])


@query
def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.document_features(table(spark, sf_dir, "documents"))


@query
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the orders to a number of files, copy them to files of a size, read the copy."""
    orders = table(spark, sf_dir, "orders")
    first, second = src.scratch_path(spark, "orders"), src.scratch_path(spark, "copy")
    src.write_dataset(orders, first, files_for(orders.count()))
    return src.copy_dataset(spark, first, second, file_bytes=COPY_BYTES)


@query
def overwrite_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the orders, then the customers to the same place: only these are left."""
    path = src.scratch_path(spark, "replaced")
    src.write_dataset(table(spark, sf_dir, "orders"), path)
    src.write_dataset(table(spark, sf_dir, "customer"), path)
    return src.read_dataset(spark, path)


@query
def failed_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the orders, then fail half way through writing others to the same place: the orders are left."""
    path = src.scratch_path(spark, "kept")
    orders = table(spark, sf_dir, "orders")
    src.write_dataset(orders, path)
    broken = F.when(F.col("o_orderkey") % 7 == 3, F.raise_error(F.lit("broken row")))
    worse = orders.withColumn("o_totalprice", F.coalesce(broken.cast("double"), "o_totalprice"))
    try:
        src.write_dataset(worse, path)
    except Exception as e:
        if "broken row" not in str(e):
            raise
    return src.read_dataset(spark, path)


@query
def files_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows and short rows in files of one size: rows read back, and whether the files have it.

    Tables that make one file are too small for it.
    """
    found = []
    for name in ("documents", "orders", "lineitem"):
        path = src.scratch_path(spark, name)
        src.write_dataset(table(spark, sf_dir, name), path, file_bytes=SMALL_FILE)
        # The scan knows its files: no listing of them in the driver, one after the other.
        back = src.read_dataset(spark, path).select("_metadata.file_path", "_metadata.file_size")
        least, most = F.min("file_size"), F.max("file_size")
        single = F.min("file_path") == F.max("file_path")
        even = F.coalesce(single | ((least >= SMALL_FILE / 2) & (most <= SMALL_FILE * 2)), F.lit(True))
        found.append(back.agg(F.lit(name).alias("name"), F.count("*").alias("n"), even.alias("even")))
    return found[0].unionAll(found[1]).unionAll(found[2])


def _files(df: DataFrame) -> set[str]:
    """The files that rows come from."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


@query
def sized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the customers and orders as two sizes of one table, one of them written again.

    The rows by size, whether the files of the other size are as they were, and whether a read of one
    size reads no other's.
    """
    root = src.scratch_path(spark, "sizes")
    orders = synthetic(spark, sf_dir, "orders", "o_orderkey")
    customers = synthetic(spark, sf_dir, "customer", "c_custkey")
    few, many = customers.count(), orders.count()
    both = customers.withColumn("size", F.lit(few)).unionAll(orders.withColumn("size", F.lit(many)))
    src.write_sizes(both, root)
    before = _files(src.read_sizes(spark, root, many))
    src.write_size(customers, root, few)
    one = src.read_sizes(spark, root, many)
    untouched = before == _files(one) and final_plan(one).files_read == len(before)
    counts = src.read_sizes(spark, root).groupBy("size").agg(
        F.count("*").alias("n"), F.sum("label").alias("labels"), F.round(F.sum("f0"), 3).alias("f0")
    )
    return counts.withColumn("untouched", F.lit(untouched))


@query
def ensure_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build a feature table of the customers where it is missing; ask for it twice."""
    size = table(spark, sf_dir, "customer").count()
    path = src.dataset_path(src.scratch_path(spark, "root"), size)

    def build() -> DataFrame:
        return synthetic(spark, sf_dir, "customer", "c_custkey")

    _, first = src.ensure_dataset(spark, path, build, files_for(size), size)
    df, second = src.ensure_dataset(spark, path, build, rows=size)
    return df.select("*", F.lit(first).alias("first_call"), F.lit(second).alias("second_call"))


# Forests


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and quality of the labelled documents, as a written table.

    The texts are measured before the join, so the join moves five numbers per document.
    Training passes over the table several times; each pass reads these numbers, not texts.
    """
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label")
    )
    features = op.document_features(table(spark, sf_dir, "documents"))
    path = src.scratch_path(spark, "features")
    src.write_dataset(op.conform(features.join(labels, "id")), path)
    return src.read_dataset(spark, path, src.FEATURE_SCHEMA)


def _tested(model, split: DataFrame) -> DataFrame:
    """What is known of a test: sizes, the share of the first label, and the bound it must pass."""
    scored = op.score(model, split.where("part = 'test'"))
    train = split.where("part = 'train'").agg(F.count("*").alias("n_train"))
    both = op.beats_majority(scored).withColumnRenamed("n", "n_test")
    n_train = train.first()["n_train"]
    return both.select(F.lit(n_train).cast("bigint").alias("n_train"), "n_test", "majority_pct", "beats_majority")


@query
def doc_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest for the quality of documents against the most frequent label."""
    split = op.written_split(_labelled_documents(spark, sf_dir))
    return _tested(op.train_forest(split.where("part = 'train'")), split)


@query
def doc_quality_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact split, 20 trees: whether the prediction of each test document is that of the nodes.

    No prediction is valid if they are not right more often than the most frequent label.
    """
    split = op.exact_split(_labelled_documents(spark, sf_dir), "id")
    path = src.scratch_path(spark, "exact")
    split.write.partitionBy("part").parquet(path)
    split = src.read_dataset(spark, path)
    model = op.train_forest(split.where("part = 'train'"))
    scored = op.score(model, split.where("part = 'test'"))
    better = op.beats_majority(scored).first()["beats_majority"]
    walked = op.walked_alike(model, split.where("part = 'test'"))
    return walked.select("id", "label", (F.col("same") & F.lit(better)).alias("valid"))


@query
def tiled_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small labelled table, tiled to as many rows as there are orders and shuffled."""
    size = table(spark, sf_dir, "orders").count()
    base = _labelled_documents(spark, sf_dir)
    tiled = op.tile(base.withColumnRenamed("id", "base"), "base", size)
    shuffled = op.permute(tiled, "id").withColumn("id", F.col("pos"))
    split = op.written_split(op.conform(shuffled))
    return _tested(op.train_forest(split.where("part = 'train'")), split)


@query
def synthetic_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic features of all orders; 30 trees on every row, tested on the same rows."""
    path = src.scratch_path(spark, "synthetic")
    src.write_dataset(synthetic(spark, sf_dir, "orders", "o_orderkey"), path)
    rows = op.assemble(src.read_dataset(spark, path, src.FEATURE_SCHEMA))
    model = op.train_forest(rows, num_trees=30)
    return op.beats_majority(op.score(model, rows))


@query
def forest_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sizes, the customers and the orders, by 20 and 30 trees: the log without its times."""
    keys = {"customer": "c_custkey", "orders": "o_orderkey"}
    sizes = {table(spark, sf_dir, name).count(): (name, key) for name, key in keys.items()}
    log = op.forest_sweep(
        spark,
        src.scratch_path(spark, "sweep"),
        list(sizes),
        trees=(20, 30),
        build=lambda n: synthetic(spark, sf_dir, *sizes[n]),
    )
    good = (F.col("accuracy_pct") > 80).alias("good")
    return log.select("size", "stage", "trees", "n_train", "n_test", "ok", good)


@query
def resumed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep over the customers that fails, is stopped after one forest, and goes on: its journal."""
    n = table(spark, sf_dir, "customer").count()
    root, journal = src.scratch_path(spark, "sweep"), src.scratch_path(spark, "journal")

    def build(_: int) -> DataFrame:
        return synthetic(spark, sf_dir, "customer", "c_custkey")

    def broken(_: int) -> DataFrame:
        raise ValueError("no rows today")

    op.forest_sweep(spark, root, [n], (5,), build=broken, journal=journal)
    op.forest_sweep(spark, root, [n], (5,), build=build, journal=journal, retry_failed=True)
    log = op.forest_sweep(spark, root, [n], (5, 8), build=broken, journal=journal)
    return log.select("size", "stage", "trees", "n_train", "n_test", "ok")


@query
def upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Making features of the customers and bringing them to their place: the log without its times."""
    n = table(spark, sf_dir, "customer").count()
    log = op.upload_sweep(
        spark,
        src.scratch_path(spark, "uploads"),
        [n],
        build=lambda _: synthetic(spark, sf_dir, "customer", "c_custkey"),
    )
    return log.select("size", "stage", "counted", "ok")


@query
def accuracy_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well "not toxic" predicts quality."""
    guess = table(spark, sf_dir, "labels").withColumn("guess", 1 - F.col("toxic"))
    return op.accuracy_pct(guess, "quality", "guess")


# Run logs


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a run log, in which good and failed runs share their keys.

    Engine, stage and cores follow from the id and the hour; errors are runs that have failed.
    One stage and one level of cores are in no list below.
    """
    cores = F.element_at(
        F.array(*[F.lit(c) for c in [*CORE_LEVELS, 8]]), F.pmod(F.hour("ts"), F.lit(5)) + 1
    )
    stage = F.element_at(
        F.array(*[F.lit(x) for x in [*STAGES, "count"]]), F.pmod("event_id", F.lit(4)).cast("int") + 1
    )
    engine = F.when(F.col("event_id") % 3 == 0, "local").otherwise("spark")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("app"),
        engine.alias("engine"),
        cores.alias("cores"),
        (F.col("user_id") * 1000).alias("size"),
        stage.alias("stage"),
        F.col("value").alias("seconds"),
        (F.col("event_type") != "error").alias("ok"),
    )


@query
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run, with the seconds of the failed ones unknown."""
    return op.mask_failed(run_log(spark, sf_dir)).drop("app")


@query
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = op.stage_summary(run_log(spark, sf_dir), STAGES)
    return summary.select("size", *[F.round(s, 2).alias(s) for s in [*STAGES, "other"]])


@query
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slowest run of each size and number of cores."""
    log = run_log(spark, sf_dir)
    matrix = op.run_matrix(log, values=CORE_LEVELS, prefix="cores_", agg="max")
    cells = [f"cores_{c}" for c in [*CORE_LEVELS, "other"]]
    return matrix.select("size", *[F.round(c, 2).alias(c) for c in cells])


@query
def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = run_log(spark, sf_dir)
    both = op.speedup(log.where("engine = 'local'"), log.where("engine = 'spark'"))
    return both.select(
        "size",
        F.round("local_seconds", 2).alias("local_seconds"),
        F.round("spark_seconds", 2).alias("spark_seconds"),
        F.round("ratio", 6).alias("ratio"),
        "winner",
    )


@query
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("o_orderkey") * 1000
    return table(spark, sf_dir, "orders").select(
        size.alias("size"),
        size_label(size).alias("label"),
        size_label(size, millions=False).alias("label_k"),
    )
