"""Random forests on a table of four features and a label."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordwood.functions.labels import files_for
from wordwood.functions.text import tokens
from wordwood.operators.runlog import RUN_LOG_SCHEMA
from wordwood.operators.sampling import hash_split
from wordwood.operators.sweeps import Journal
from wordwood.sources.datasets import (
    FEATURE_COLS,
    FEATURE_SCHEMA,
    dataset_path,
    ensure_dataset,
    read_dataset,
)
from wordwood.sources.generate import gen_classification
from wordwood.sources.scratch import scratch_path

# Fixed value: trees of a forest, unless asked for otherwise.
TREES = 20

# The columns of a run log, and what else is known of a training run.
SWEEP_SCHEMA = T.StructType(
    [
        *RUN_LOG_SCHEMA.fields,
        T.StructField("trees", T.IntegerType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_test", T.LongType()),
        T.StructField("accuracy_pct", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

# A journal also tells by which split a run was tested.
JOURNAL_SCHEMA = T.StructType(
    [*SWEEP_SCHEMA.fields, T.StructField("test", T.DoubleType()), T.StructField("seed", T.LongType())]
)


def conform(df: DataFrame) -> DataFrame:
    """Project to the feature schema: float features, int label, whatever the producer."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA])


def assemble(df: DataFrame, cols: Iterable[str] = FEATURE_COLS) -> DataFrame:
    """Add the vector column ``features``. A null feature is an error."""
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def document_features(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """Four features of a text: ``id, f0..f3``.

    Characters, tokens, share of ASCII letters, share of distinct tokens; 0 for empty text.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    measured = df.select(
        F.col(key).alias("id"),
        F.length(text).alias("chars"),
        F.length(F.regexp_replace(text, "[A-Za-z]+", "")).alias("others"),
        tokens(text).alias("words"),
    ).select(
        "id",
        "chars",
        (F.col("chars") - F.col("others")).alias("letters"),
        F.size("words").alias("tokens"),
        F.size(F.array_distinct("words")).alias("distinct_tokens"),
    )

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    features = [
        F.col("chars"),
        F.col("tokens"),
        share("letters", "chars"),
        share("distinct_tokens", "tokens"),
    ]
    return measured.select(
        "id", *[f.cast("float").alias(c) for c, f in zip(FEATURE_COLS, features, strict=True)]
    )


def _count_classes(df: DataFrame, label: str) -> int:
    """Number of classes, after checking that the labels are 0..k-1 without a gap."""
    y = F.col(label)
    seen = df.agg(
        F.min(y).alias("low"),
        F.max(y).alias("high"),
        F.count_distinct(y).alias("classes"),
        F.count_if(y.isNull() | (y != F.floor(y))).alias("bad"),
    ).first()
    if seen["bad"] or seen["low"] != 0 or seen["high"] != seen["classes"] - 1:
        raise ValueError(
            f"labels must be the integers 0..k-1 without a gap: found {seen['classes']} "
            f"different ones from {seen['low']} to {seen['high']}, {seen['bad']} null or fractional"
        )
    return seen["classes"]


def train_forest(
    train: DataFrame,
    num_trees: int = TREES,
    seed: int = 42,
    max_depth: int = 5,
    label: str = "label",
    features: str = "features",
) -> RandomForestClassificationModel:
    """Fit a forest on all rows of ``train``; defaults of Spark otherwise.

    The class count found by the label check goes along as column metadata, which spares
    Spark its own pass over the data for it.
    """
    train = _assembled(train) if features == "features" else train
    classes = _count_classes(train, label)
    nominal = {"ml_attr": {"name": label, "type": "nominal", "num_vals": classes}}
    typed = train.select(
        features, F.col(label).cast("double").alias(label, metadata=nominal)
    )
    forest = RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=num_trees, maxDepth=max_depth, seed=seed
    )
    return forest.fit(typed)


def score(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``rawPrediction``, ``probability`` and ``prediction``."""
    return model.transform(_assembled(df))


def _right(label: str, prediction: str) -> Column:
    return (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")


def accuracy_pct(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: the share of right predictions, in percent."""
    return df.agg((F.lit(100.0) * F.avg(_right(label, prediction))).alias("accuracy_pct"))


def beats_majority(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row about scored rows: ``n, majority_pct, beats_majority``.

    The last one is a bound, not a measure: whether the predictions are right more often than the
    most frequent label alone would be. A constant prediction is not.
    """
    right = F.sum(_right(label, prediction)).alias("right")
    counts = df.groupBy(label).agg(F.count("*").alias("n"), right)
    return counts.agg(
        F.sum("n").alias("n"),
        (F.lit(100.0) * F.max("n") / F.sum("n")).alias("majority_pct"),
        (F.sum("right") > F.max("n")).alias("beats_majority"),
    )


def evaluate_forest(model: RandomForestClassificationModel, split: DataFrame) -> DataFrame:
    """One row about a table with ``part``: ``n_train, n_test, accuracy_pct``.

    The accuracy is that on the test part; null if there is none. Only the test part is scored.
    """
    tested = score(model, split.where("part = 'test'"))
    right = _right("label", "prediction").alias("right")
    trained = split.where("part = 'train'").select("part", F.lit(None).cast("double").alias("right"))
    return tested.select("part", right).unionAll(trained).agg(
        F.count_if(F.col("part") == "train").alias("n_train"),
        F.count_if(F.col("part") == "test").alias("n_test"),
        (F.lit(100.0) * F.avg("right")).alias("accuracy_pct"),
    )


def written_split(
    df: DataFrame, key: str = "id", test: float | None = 0.2, seed: int = 42
) -> DataFrame:
    """The feature table split and written, one folder per part.

    A forest passes over its rows many times: so each pass reads the files of one part, and
    neither splits again nor drops rows. Without ``test`` all rows are in ``train``. The vectors are
    assembled behind the choice of a part, which no filter could pass.
    """
    spark = df.sparkSession
    split = df.withColumn("part", F.lit("train"))
    if test is not None:
        split = hash_split(df, key, test, seed)
    path = scratch_path(spark, "split")
    split.write.partitionBy("part").parquet(path)
    part = T.StructField("part", T.StringType())
    return read_dataset(spark, path, T.StructType([*df.schema.fields, part]))


def _assembled(df: DataFrame) -> DataFrame:
    return df if "features" in df.columns else assemble(df)


def forest_sweep(
    spark: SparkSession,
    root: str,
    sizes: Iterable[int],
    trees: Iterable[int] = (TREES,),
    test: float | None = 0.2,
    seed: int = 42,
    build: Callable[[int], DataFrame] | None = None,
    journal: str | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """Train and test a forest for each size and number of trees: a run log of all stages.

    Stages are ``generate`` (making or finding the dataset, and splitting it), once per size, and
    ``train``. The datasets are kept under ``root`` and made there if they are missing, by
    ``build(size)`` or else the generator. Without ``test`` the forest is trained on all rows. The
    seconds of ``train`` cover reading and training, not testing. What fails in Spark is a row with
    ``ok = false``, the error, and nulls; a dataset that fails takes its training runs with it.

    With a path as ``journal`` every run is written down there when it ends. A sweep that was stopped
    goes on with the first run that is missing; with ``retry_failed`` those that failed are done again.
    Runs with another ``test`` or ``seed`` are other runs. The log is that of the journal.
    """
    make = build or (lambda n: gen_classification(spark, n))
    trees, runs, done, kept = list(trees), [], {}, None
    if journal:
        kept = Journal(spark, journal, JOURNAL_SCHEMA, ["size", "stage", "trees", "test", "seed"])
        done = kept.finished(retry_failed)

    def ended(size: int, stage: str, n: int | None = None) -> bool:
        return (size, stage, n, test, seed) in done

    def note(row: tuple) -> None:
        runs.append(row)
        if kept:
            kept.append([(*row, test, seed)])

    for size in sizes:
        left = [n for n in trees if not ended(size, "train", n)]
        if not left and ended(size, "generate"):
            continue
        started = time.monotonic()
        try:
            df, _ = ensure_dataset(
                spark, dataset_path(root, size), lambda n=size: make(n), files_for(size)
            )
            split = written_split(df, "id", test, seed)
        except (PySparkException, Py4JJavaError, ValueError) as e:
            note(_row(spark, size, "generate", None, e))
            for n in left:
                note(_row(spark, size, "train", None, e, n))
            continue
        if not ended(size, "generate"):
            note(_row(spark, size, "generate", time.monotonic() - started))
        for n in left:
            note(_run(split, size, n, seed))
    if not kept:
        return spark.createDataFrame(runs, SWEEP_SCHEMA)
    same = F.col("test").eqNullSafe(F.lit(test)) & (F.col("seed") == seed)
    return kept.log().where(same).select(*SWEEP_SCHEMA.names)


def _row(spark, size, stage, seconds, error=None, trees=None, counts=(None, None, None)) -> tuple:
    cores = spark.sparkContext.defaultParallelism
    message = str(error).split("\n", 1)[0] if error is not None else None
    known = ("forest", "spark", cores, size, stage, seconds, error is None)
    return (*known, trees, *counts, message)


def _run(split: DataFrame, size: int, n_trees: int, seed: int) -> tuple:
    spark = split.sparkSession
    started = time.monotonic()
    try:
        model = train_forest(split.where("part = 'train'"), n_trees, seed)
        seconds = time.monotonic() - started
        row = evaluate_forest(model, split).first()
    except (PySparkException, Py4JJavaError) as e:
        return _row(spark, size, "train", None, e, n_trees)
    counts = (row["n_train"], row["n_test"], row["accuracy_pct"])
    return _row(spark, size, "train", seconds, None, n_trees, counts)
