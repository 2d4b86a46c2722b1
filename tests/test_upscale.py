from collections import Counter

import numpy as np
import pytest
from helpers import as_dict, column
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood import sources as src
from wordwood.operators import upscale


@pytest.fixture(scope="module")
def base(spark):
    """Seven rows of three classes; keys with gaps, not in order."""
    rows = [(k, k % 3) for k in (50, 10, 70, 20, 40, 90, 30)]
    return spark.createDataFrame(rows, "k long, label int")


KEYS = [10, 20, 30, 40, 50, 70, 90]


@pytest.mark.parametrize("size", [1, 3, 7, 8, 21, 1000])
def test_tile_is_numpy_tile(base, size):
    want = np.tile(KEYS, -(-size // 7))[:size].tolist()
    assert column(op.tile(base, "k", size).orderBy("id"), "k") == want


@pytest.mark.parametrize("size", [3, 7, 100, 1000])
def test_tile_in_blocks_and_tasks(base, monkeypatch, size):
    monkeypatch.setattr(upscale, "BLOCK", 4)
    monkeypatch.setattr(upscale, "ROWS_PER_TASK", 10)
    got = op.tile(base, "k", size)
    assert column(got.orderBy("id"), "k") == np.tile(KEYS, -(-size // 7))[:size].tolist()
    assert column(got.orderBy("id"), "id") == list(range(size))


@pytest.mark.parametrize("size", [5, 400, 1000, 5000])
def test_tile_of_a_table_in_several_parts(spark, size):
    base = spark.range(0, 400, 1, 5).selectExpr("id * 3 AS k", "cast(id % 4 as int) AS label")
    got = op.tile(base.repartition(6), "k", size).orderBy("id")
    assert column(got, "k") == np.tile(np.arange(400) * 3, -(-size // 400))[:size].tolist()


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("concat('k', lpad(cast(id as string), 4, '0')) AS k")
    df = df.repartition(5).selectExpr("k", "1 AS _at", "2 AS _part", "3 AS _rows")
    got = op.dense_index(df, "k")
    assert got.columns == ["k", "_at", "_part", "_rows", "i"]
    assert as_dict(got.select("k", "i")) == {f"k{i:04d}": i for i in range(1000)}
    assert got.select("_at", "_part", "_rows").distinct().collect() == [(1, 2, 3)]


def test_tile_names_its_column(spark):
    rows = src.gen_classification(spark, 5)
    with pytest.raises(ValueError, match="id"):
        op.tile(rows, "id", 12)
    got = op.tile(rows, "id", 12, "row").orderBy("row")
    assert got.columns == ["row", *rows.columns]
    assert column(got, "id") == [*range(5), *range(5), 0, 1]


def test_class_counts_differ_by_one_repeat(base):
    got = as_dict(op.tile(base, "k", 1000).groupBy("label").count())
    want = Counter(k % 3 for k in np.tile(KEYS, 143)[:1000].tolist())
    assert got == want


def test_one_row_is_spread_over_tasks(spark, monkeypatch):
    """A single base row: many tasks make its copies, none makes more than its share."""
    monkeypatch.setattr(upscale, "BLOCK", 100)
    monkeypatch.setattr(upscale, "ROWS_PER_TASK", 1000)
    got = op.tile(spark.createDataFrame([(1,)], "k int"), "k", 8000)
    per_task = as_dict(got.groupBy(F.spark_partition_id()).count())
    assert len(per_task) == 8 and max(per_task.values()) <= 2000


def test_number_copies(spark):
    rows = [("a", 1)] * 5 + [("b", None)] * 2 + [("c", 3)]
    df = spark.createDataFrame(rows, "x string, y int").repartition(4)
    got = sorted(map(str, map(tuple, op.number_copies(df).collect())))
    want = [("a", 1, i) for i in range(5)] + [("b", None, i) for i in range(2)] + [("c", 3, 0)]
    assert got == sorted(map(str, want))


def test_copies_of_one_row_are_dealt_out(spark, monkeypatch):
    """A third of the rows are the same one: counted ahead of the shuffle, made by all tasks."""
    monkeypatch.setattr(upscale, "BLOCK", 100)
    df = spark.range(0, 30_000, 1, 6).selectExpr("if(id % 3 = 0, -1, id) AS k")
    got = op.number_copies(df)
    hot = as_dict(got.where("k = -1").groupBy(F.spark_partition_id()).count())
    assert sum(hot.values()) == 10_000 and len(hot) == 8 and max(hot.values()) <= 2_000
    shuffled = op.permute(got, ["k", "copy"])
    assert sorted(column(shuffled, "pos")) == list(range(1, 30_001))
    thirds = shuffled.where("k = -1").agg(F.avg("pos")).first()[0]
    assert abs(thirds - 15_000) < 500


def test_tile_of_nothing(spark):
    with pytest.raises(ValueError, match="empty"):
        op.tile(spark.range(0), "id", 10, "row")


@pytest.mark.parametrize("slices", [None, 4])
def test_replicate_no_times(spark, slices):
    df = spark.createDataFrame([("a",)], "text string")
    assert op.replicate(df, 0, slices).count() == 0
    with pytest.raises(ValueError, match="negative"):
        op.replicate(df, -1, slices)


def test_replicate_makes_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(upscale, "BLOCK", 7)
    df = spark.createDataFrame([("a", 1)], "text string, _copy int")
    for slices in (None, 3):
        got = op.replicate(df, 50, slices)
        assert got.columns == df.columns and got.count() == 50
        assert got.distinct().collect() == [("a", 1)]


@pytest.mark.parametrize(("m", "slices"), [(1, None), (5, None), (5, 24), (50, 24), (24, 24), (7, 3)])
def test_replicate(spark, m, slices):
    df = spark.createDataFrame([("a b",), ("b",)], "text string")
    got = op.replicate(df, m, slices)
    assert got.columns == ["text"]
    assert as_dict(got.groupBy("text").count()) == {"a b": m, "b": m}
    counts = as_dict(op.word_counts(got))
    assert counts == {"a": m, "b": 2 * m}


def test_replicate_uses_the_slices(spark):
    got = op.replicate(spark.createDataFrame([("x",)], "text string"), 240, 24)
    per_task = as_dict(got.groupBy(F.spark_partition_id()).count())
    assert len(per_task) == 24 and set(per_task.values()) == {10}


def test_no_row_is_joined_to_its_copies(base):
    """Copies are exploded; only the offsets of sorted parts are joined, and sent to all tasks."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(op.replicate(base, 10)) + plan(op.replicate(base, 10, 4))
    tiled = plan(op.tile(base, "k", 1000))
    assert tiled.count("Join") == tiled.count("BroadcastHashJoin") == 1


def test_rows_of_a_large_table_are_moved_once(spark):
    """With slices, too: what is dealt out are the rows, not a row for each copy; the slices get even shares."""
    df = spark.range(0, 5000, 1, 4).selectExpr("concat('text ', id) AS text")
    got = op.replicate(df, 10, 24)
    assert got.count() == 50_000 and got.distinct().count() == 5000
    per_task = as_dict(got.groupBy(F.spark_partition_id()).count())
    assert len(per_task) == 24 and max(per_task.values()) < 1.2 * 50_000 / 24
    moved = got.select("text", F.spark_partition_id().alias("task")).distinct().count()
    assert moved == 5000


def test_one_heavy_row_among_many_is_shared_by_the_slices(spark):
    df = spark.range(500).selectExpr("if(id = 7, repeat('x', 1000000), 'y') AS text")
    got = op.replicate(df, 48, 24).where("length(text) > 1")
    per_task = as_dict(got.groupBy(F.spark_partition_id()).count())
    assert sum(per_task.values()) == 48 and len(per_task) >= 12


def test_copies_are_counted_once(spark):
    """What reads the numbered rows, twice in a permutation, reads counted rows and does not count again."""
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", None)] * 2, "x string, y int")
    got = op.number_copies(df)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(column(op.permute(got, got.columns), "pos")) == list(range(1, 8))
