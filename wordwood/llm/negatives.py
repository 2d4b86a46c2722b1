"""Hard negatives for embeddings, by a vertical scan with branch and bound.

Vectors become whole numbers and are kept in blocks, column by column, with the least and the
largest value of each column. For an anchor the columns of a block are read in descending order of
the anchor's own magnitude, a few at a time. What the unread columns can still add or take away is
known from their bounds, so each candidate has a lower and an upper score; those that can be
no answer any more leave the candidates, and only the rest is read on, until all scores are exact.

Two such searches: first the best rows of the anchor's label, the positives. Each positive's score
makes a window, and the second search looks for the best rows of other labels in all windows of an
anchor at once.

Anchors meet rows in cells: a group of blocks and a lot of anchors, both of bounded size. Only a
cell's best few rows per anchor go on, so the cells of an anchor are merged from small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordwood.llm.common import written

# Steps of a component, anchors and changed labels by id, positives, negatives, and
# the window in percent of the positive's score.
SCALE = 256
ANCHOR_EVERY, CHANGE_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LEAST_PCT, MOST_PCT = 30, 90

# Rows of a block; rows and anchors of a cell.
BLOCK_ROWS, CELL_ROWS, CELL_ANCHORS = 4096, 8192, 8192

# Columns that are read before the candidates are looked through again.
COLUMNS_AT_ONCE = 8

# Whole numbers below this are exact as doubles; scores stay below the second.
EXACT, LARGEST = 2.0**53, 2.0**62

BLOCKS = "block long, n int, ids binary, labels binary, kind string, columns binary"
FOUND = "anchor long, slot int, score long, id long, place long"


def _smallest_kind(values: np.ndarray) -> str:
    most = np.abs(values).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows ``id, label, vector`` that take part."""
    first = TaskContext.get().partitionId() << 24
    ids, labels, parts, widths, held = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal first
        n, all_widths = sum(map(len, ids)), np.concatenate(widths)
        # Shorter vectors end in zeros.
        table = np.zeros((n, all_widths.max(initial=0)), np.int64)
        table[np.arange(table.shape[1]) < all_widths[:, None]] = np.concatenate(parts)
        kind = _smallest_kind(table)
        row = {
            "block": pa.array([first], pa.int64()),
            "n": pa.array([n], pa.int32()),
            "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()),
            "labels": pa.array([np.concatenate(labels).tobytes()], pa.binary()),
            "kind": [kind],
            "columns": pa.array([np.ascontiguousarray(table.T.astype(kind)).tobytes()], pa.binary()),
        }
        first += 1
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            vectors = some.column(2)
            width = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(float))
                of = np.repeat(np.arange(len(width)), width)
                length = np.bincount(of, values * values, minlength=len(width))
                takes_part = length < LARGEST
            if not takes_part.any():
                continue
            # Ids with a mark for null ones, which come after all others.
            known = some.column(0).is_valid().to_numpy(zero_copy_only=False)
            number = some.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids.append(np.stack([~known, number], axis=1).astype(np.int64)[takes_part])
            labels.append(some.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[takes_part])
            parts.append(values[takes_part[of]].astype(np.int64))
            widths.append(width[takes_part])
            held += int(takes_part.sum())
            if held >= BLOCK_ROWS // 2:
                yield block()
                ids, labels, parts, widths, held = [], [], [], [], 0
    if held:
        yield block()


class Block:
    """Rows in columns, with the bounds of each column."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64).reshape(-1, 2)
        self.labels = np.frombuffer(row.labels, np.int64)
        columns = np.frombuffer(row.columns, row.kind)
        self.whole = columns.reshape(-1, row.n) if len(columns) else np.zeros((0, row.n), np.int64)
        self.columns = self.whole.astype(float)
        self.least, self.most = self.columns.min(1, initial=0), self.columns.max(1, initial=0)
        # A row's place says where it is stored, so equal rows have different places.
        self.places = (row.block << 13) + np.arange(row.n)

    def scores(self, query: np.ndarray, candidates: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that ``prune(lower, upper)`` leaves over, and their scores."""
        query = query[: len(self.whole)]
        order = np.argsort(-np.abs(query), kind="stable")
        order = order[query[order] != 0]
        least, most = self.least[order], self.most[order]
        q = query[order].astype(float)
        if np.abs(q) @ np.maximum(-least, most) >= EXACT:
            # Too long for doubles; summed whole.
            return candidates, query @ self.whole[: len(query)][:, candidates].astype(np.int64)
        up, down = np.maximum(q * least, q * most), np.minimum(q * least, q * most)
        up = np.append(np.cumsum(up[::-1])[::-1], 0)
        down = np.append(np.cumsum(down[::-1])[::-1], 0)
        sums = np.zeros(len(candidates))
        for at in range(0, len(order), COLUMNS_AT_ONCE):
            read = order[at : at + COLUMNS_AT_ONCE]
            if len(candidates) == self.whole.shape[1]:
                sums += q[at : at + COLUMNS_AT_ONCE] @ self.columns[read]
            else:
                sums += q[at : at + COLUMNS_AT_ONCE] @ self.columns[read[:, None], candidates]
            left = min(at + COLUMNS_AT_ONCE, len(order))
            keep = prune(sums + down[left], sums + up[left])
            candidates, sums = candidates[keep], sums[keep]
            if not len(candidates):
                break
        return candidates, sums.astype(np.int64)


class Best:
    """The best rows so far, at most ``k``: by score, then id, then place."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.empty((0, 4), np.int64)

    @property
    def floor(self) -> float:
        """A score below this is not among the best."""
        return float(self.rows[-1, 0]) if len(self.rows) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([scores, ids, places])])
        if len(rows) > 4 * self.k:
            cut = np.partition(rows[:, 0], len(rows) - self.k)[len(rows) - self.k]
            rows = rows[rows[:, 0] >= cut]
        order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0]))
        self.rows = rows[order[: self.k]]


def _kth_largest(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_of_label(blocks: list[Block], anchor, k: int) -> list[Best]:
    """The best rows of the anchor's label but itself."""
    best = Best(k)
    query = np.frombuffer(anchor.vector, np.int64)
    for block in blocks:
        own = np.flatnonzero((block.labels == anchor.label) & (block.places != anchor.place))

        def prune(lower, upper):
            return upper >= max(best.floor, _kth_largest(lower, k))

        own, scores = block.scores(query, own, prune)
        best.add(scores, block.ids[own], block.places[own])
    return [best]


def best_in_windows(blocks: list[Block], anchor, k: int) -> list[Best]:
    """For each window of the anchor the best rows of other labels in it."""
    windows = [(-(-LEAST_PCT * p // 100), MOST_PCT * p // 100) for p in map(int, anchor.positives)]
    all_best = [Best(k) for _ in windows]
    query = np.frombuffer(anchor.vector, np.int64)
    for block in blocks:
        others = np.flatnonzero(block.labels != anchor.label)

        def prune(lower, upper):
            keep = np.zeros(len(lower), bool)
            for (least, most), best in zip(windows, all_best, strict=True):
                if least <= most:
                    # Rows that are in the window whatever comes.
                    sure = lower[(lower >= least) & (upper <= most)]
                    keep |= (upper >= max(least, best.floor, _kth_largest(sure, k))) & (lower <= most)
            return keep

        others, scores = block.scores(query, others, prune)
        for (least, most), best in zip(windows, all_best, strict=True):
            inside = (scores >= least) & (scores <= most)
            best.add(scores[inside], block.ids[others[inside]], block.places[others[inside]])
    return all_best


def _found(rows: list[tuple[int, int, Best]]) -> pd.DataFrame:
    n = [len(best.rows) for _, _, best in rows]
    every = np.concatenate([np.empty((0, 4), np.int64), *(best.rows for _, _, best in rows)])
    return pd.DataFrame(
        {
            "anchor": np.repeat(np.array([a for a, _, _ in rows], np.int64), n),
            "slot": np.repeat(np.array([s for _, s, _ in rows], np.int32), n),
            "score": every[:, 0],
            "id": pd.Series(every[:, 2], dtype="Int64").mask(every[:, 1] != 0),
            "place": every[:, 3],
        }
    )


def _searched(search, k: int):
    """One cell: its anchors among the rows of its blocks."""

    def cell(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or anchors.empty:
            return _found([])
        made = [Block(row) for row in blocks.sort_values("block").itertuples()]
        return _found(
            [
                (anchor.place, slot, best)
                for anchor in anchors.itertuples()
                for slot, best in enumerate(search(made, anchor, k))
            ]
        )

    return cell


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pandas().itertuples():
            block = Block(row)
            own = np.flatnonzero((block.ids[:, 1] % ANCHOR_EVERY == 0) & (block.ids[:, 0] == 0))
            yield pa.RecordBatch.from_pydict(
                {
                    "place": pa.array(block.places[own], pa.int64()),
                    "anchor_id": pa.array(block.ids[own, 1], pa.int64()),
                    "label": pa.array(block.labels[own], pa.int64()),
                    "vector": pa.array(
                        [v.tobytes() for v in block.whole[:, own].T.astype(np.int64)], pa.binary()
                    ),
                }
            )


def _in_cells(blocks: DataFrame, anchors: DataFrame, groups: int, lots: int, search, k: int) -> DataFrame:
    """The best ``k`` rows of each search of each anchor, as ``FOUND`` and ``rank``."""
    each_lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    each_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    left = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("grp"), each_lot)
    right = anchors.select("*", F.pmod(F.xxhash64("place"), F.lit(lots)).cast("int").alias("lot"), each_group)
    found = (
        left.groupBy("grp", "lot")
        .cogroup(right.groupBy("grp", "lot"))
        .applyInPandas(_searched(search, k), FOUND)
    )
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "place"]
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Hard negatives of all anchors.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each
    anchor and each of its ``POSITIVES`` best rows of the same label the ``NEGATIVES`` best rows of
    other labels whose score is within the window of the positive's score. Scores are inner products of
    ``floor(256 * x)``; ties go to the smaller id.

    Rows with a null label, a null vector or a component that is null or not finite take no
    part, nor do those whose squared length reaches 2^62, whose scores might not fit. Null
    ids come last among ties and are never anchors. A vector is as if it went on with zeros; one without
    components scores 0. Repeated rows are rows of their own: each is an anchor, and a positive or
    negative of others, next to its twins. An empty table gives an empty one. Other columns are not read.
    """
    change = F.coalesce(F.col(key) % CHANGE_EVERY == 0, F.lit(False))
    number = F.col(label).cast("bigint")
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.when(change, (number + 1) % LABELS).otherwise(number).alias("label"),
        F.col(vector).alias("vector"),
    )
    blocks = written(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    anchors = written(
        blocks.mapInArrow(_anchors, "place long, anchor_id long, label long, vector binary"), "anchors"
    )
    groups = -(-(blocks.agg(F.sum("n")).first()[0] or 1) // CELL_ROWS)
    lots = -(-max(1, anchors.count()) // CELL_ANCHORS)

    positives = written(
        _in_cells(blocks, anchors, groups, lots, best_of_label, POSITIVES), "positives"
    )
    lists = positives.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("list")
    )
    with_windows = anchors.join(lists, F.col("place") == F.col("anchor")).select(
        "place", "label", "vector", F.col("list.score").alias("positives")
    )
    negatives = _in_cells(blocks, with_windows, groups, lots, best_in_windows, NEGATIVES)

    names = anchors.select(F.col("place").alias("anchor"), "anchor_id")
    of = positives.join(names, "anchor").select(
        "anchor",
        "anchor_id",
        (F.col("rank") - 1).alias("slot"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return negatives.join(of, ["anchor", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
