"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.llm.common import written


def components(nodes: DataFrame, edges: DataFrame, folder: str | None = None) -> DataFrame:
    """The component of every node: ``node, label``, where label is its smallest node.

    ``nodes`` has a column ``node``, each once; ``edges`` has ``a, b``. Every round each node
    takes the smallest label around it, then the label of its label, so long paths shorten by
    half a round. Each round is a written table, and the driver learns one number of it: how
    many labels changed. A node with very many edges gets one row for each, which are summed up
    within tasks before they meet. The tables are written beneath ``folder`` where it is given.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges", folder)
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels", folder)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(
            F.min("label").alias("near")
        )
        stepped = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", "label", F.least("label", "near").alias("new")
        )
        of_label = labels.select(F.col("node").alias("n"), F.col("label").alias("further"))
        jumped = stepped.join(of_label, stepped["new"] == of_label["n"]).select(
            "node", "label", F.least("new", "further").alias("new")
        )
        after = written(jumped, "labels", folder)
        changed = after.where("label <> new").count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
