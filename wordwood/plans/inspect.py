"""What Spark did with a query: its final plan, after adaptive execution has changed it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Shuffle:
    """One read of a shuffle: partitions written, tasks that read them, and why these differ."""

    partitions: int
    tasks: int
    coalesced: bool
    split: bool


@dataclass
class FinalPlan:
    nodes: list[str] = field(default_factory=list)
    shuffles: list[Shuffle] = field(default_factory=list)
    broadcasts: int = 0
    # Files that the scans of the plan have opened, after partitions were pruned.
    files_read: int = 0

    @property
    def coalesces(self) -> bool:
        return any(s.coalesced for s in self.shuffles)

    @property
    def splits_skew(self) -> bool:
        return any(s.split for s in self.shuffles)


def _inside(node) -> list:
    """What a node holds: the plan of an adaptive one, of a stage, or its children."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "ReusedExchangeExec":
        return []
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def final_plan(df: DataFrame) -> FinalPlan:
    """Run a query, keep none of its rows, and return the plan that ran.

    Needs a session on Spark's own JVM, not a remote one.
    """
    query = df._jdf.queryExecution()
    query.toRdd().count()
    found = FinalPlan()
    todo = [(query.executedPlan(), None)]
    while todo:
        node, read = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AQEShuffleReadExec":
            read = node
        elif kind == "ShuffleExchangeExec":
            n = node.outputPartitioning().numPartitions()
            tasks = read.partitionSpecs().size() if read else n
            coalesced = bool(read and read.hasCoalescedPartition())
            found.shuffles.append(Shuffle(n, tasks, coalesced, bool(read and read.hasSkewedPartition())))
            read = None
        elif kind == "BroadcastExchangeExec":
            found.broadcasts += 1
        elif kind == "FileSourceScanExec":
            found.files_read += node.metrics().apply("numFiles").value()
        if not kind.startswith(("AdaptiveSparkPlan", "InputAdapter", "WholeStageCodegen")) and "QueryStage" not in kind:
            found.nodes.append(kind.removesuffix("Exec"))
        todo += [(child, read) for child in _inside(node)]
    return found
