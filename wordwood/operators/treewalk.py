"""A fitted forest as a table of nodes, and predictions by walking it with joins.

An independent way to the predictions of Spark's forest: nothing of its code runs, only what it
saved of its trees.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.operators.forest import score
from wordwood.sources.datasets import FEATURE_COLS, read_dataset
from wordwood.sources.scratch import scratch_path

# A table of so many nodes is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_NODES = 100_000


def forest_nodes(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """The nodes of all trees: ``tree, node, feature, threshold, left, right, votes``.

    ``left`` and ``right`` are null in leaves. ``votes`` are the shares of the classes among the training
    rows of a node. Features must be numbers, not categories.
    """
    path = scratch_path(df.sparkSession, "forest")
    model.write().save(path)
    node = F.col("nodeData")
    total = F.aggregate(node["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    inner = node["leftChild"] >= 0
    return read_dataset(df.sparkSession, f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left"),
        F.when(inner, node["rightChild"]).alias("right"),
        F.transform(node["impurityStats"], lambda x: F.try_divide(x, total)).alias("votes"),
    )


def walk_forest(
    model: RandomForestClassificationModel, df: DataFrame, key: str = "id", cols: list[str] = FEATURE_COLS
) -> DataFrame:
    """The predictions for the rows of ``df``: ``key, votes, prediction``.

    Every row starts at the root of each tree and goes a level down with each join, as often as the
    deepest tree has levels; rows in leaves stay. ``votes`` sums the shares of the leaves; the
    first class of most votes is the prediction. Keys must be unique.
    """
    nodes = forest_nodes(model, df)
    if model.totalNumNodes <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    trees = F.explode(F.sequence(F.lit(0), F.lit(model.getNumTrees - 1))).alias("tree")
    values = F.array(*[F.col(c).cast("double") for c in cols]).alias("values")
    at = df.select(F.col(key).alias("key"), values, trees).withColumn("node", F.lit(0))
    for _ in range(max(t.depth for t in model.trees)):
        here = at.join(nodes, ["tree", "node"])
        goes_left = F.get("values", F.col("feature")) <= F.col("threshold")
        on = F.when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = here.select("key", "values", "tree", F.coalesce(on, F.col("node")).alias("node"))
    leaves = at.join(nodes, ["tree", "node"])
    sums = [F.sum(F.get("votes", F.lit(c))).alias(f"v{c}") for c in range(model.numClasses)]
    voted = leaves.groupBy("key").agg(*sums)
    votes = F.array(*[F.col(f"v{c}") for c in range(model.numClasses)])
    first = F.array_position(votes, F.array_max(votes)) - 1
    return voted.select(F.col("key").alias(key), votes.alias("votes"), first.cast("double").alias("prediction"))


def walked_alike(
    model: RandomForestClassificationModel, df: DataFrame, key: str = "id"
) -> DataFrame:
    """Whether Spark's predictions are those of the walk, row by row: ``key, label, prediction, same``.

    ``same`` asks for equal votes, up to rounding, and for the predicted class; where two classes have equal
    votes up to rounding, either is right.
    """
    walked = walk_forest(model, df, key).select(F.col(key).alias("k"), "votes", F.col("prediction").alias("walked"))
    scored = score(model, df).select(key, "label", "prediction", vector_to_array("rawPrediction").alias("raw"))
    both = scored.join(walked, scored[key] == walked["k"])
    near = F.forall(F.arrays_zip("raw", "votes"), lambda x: F.abs(x["raw"] - x["votes"]) < 1e-9)
    chosen = F.get("votes", F.col("prediction").cast("int"))
    same = near & (F.array_max("votes") - chosen < 1e-9)
    return both.select(key, "label", "prediction", F.coalesce(same, F.lit(False)).alias("same"))
