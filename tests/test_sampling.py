import hashlib
import math

import pytest
from helpers import as_dict, column
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood.functions import row_hash
from wordwood.operators import sampling


def digest(key, seed=42):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 5000, 1, 3).withColumn("name", F.concat(F.lit("n"), "id"))


def test_permute_is_the_order_of_the_hash(ids):
    got = as_dict(op.permute(ids, "id").select("id", "pos"))
    want = sorted(range(5000), key=lambda i: (digest(i), i))
    assert got == {i: at for at, i in enumerate(want, start=1)}


def test_permute_keeps_the_rows(ids):
    got = op.permute(ids, "id")
    assert got.columns == ["id", "name", "pos"]
    assert got.drop("pos").exceptAll(ids).count() == 0
    assert got.count() == 5000


def test_seed_changes_the_order(ids):
    a = op.permute(ids, "id").orderBy("pos")
    b = op.permute(ids, "id", seed=7).orderBy("pos")
    assert column(a, "id") != column(b, "id")


@pytest.mark.parametrize("operator", [op.permute, op.hash_split, op.exact_split])
def test_partitions_do_not_matter(ids, operator):
    a, b = operator(ids, "id"), operator(ids.repartition(7), "id")
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_composite_key(spark):
    df = spark.range(60).selectExpr("id div 10 AS a", "id % 10 AS b")
    got = op.permute(df, ["a", "b"])
    assert sorted(column(got, "pos")) == list(range(1, 61))
    assert op.exact_split(df, ["a", "b"], 0.25).where("part = 'test'").count() == 15


def test_hash_split_share(ids):
    parts = as_dict(op.hash_split(ids, "id").groupBy("part").count())
    assert parts["test"] == sum(digest(i)[:8] < "33333333" for i in range(5000))
    assert parts["test"] + parts["train"] == 5000
    assert abs(parts["test"] / 5000 - 0.2) < 0.02


def test_splits_do_not_shuffle(ids):
    for df in (op.hash_split(ids, "id"), op.exact_split(ids, "id")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("test", [0.2, 0.1, 0.25, 0.3, 0.5, 0.999])
def test_exact_split_is_exact(ids, test):
    got = op.exact_split(ids, "id", test)
    n = math.ceil(round(test * 5000, 6))
    want = set(sorted(range(5000), key=digest)[:n])
    assert set(column(got.where("part = 'test'"), "id")) == want
    assert got.where("part = 'train'").count() == 5000 - n


def test_columns_of_the_same_names_are_kept(spark):
    df = spark.range(50).selectExpr("id", "'mine' AS _hash", "id AS _bucket", "2 AS _rank", "3 AS _start")
    got = op.permute(df, "id")
    assert got.columns == [*df.columns, "pos"]
    assert got.drop("pos").exceptAll(df).count() == 0
    assert as_dict(got.select("id", "pos")) == as_dict(op.permute(df.select("id"), "id"))


def test_composite_keys_do_not_collide(spark):
    rows = [("a-b", "c"), ("a", "b-c"), (None, "1"), ("1", None), (None, None), ("", ""), ("-", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_hash(["x", "y"], 1)).distinct().count() == len(rows)
    assert op.exact_split(df, ["x", "y"], 0.5).where("part = 'test'").count() == 4


def test_only_a_number_travels_with_the_rows(ids):
    plan = op.permute(ids, "id")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression", 1)
    assert "md5" in above and "_hash" not in below.split("Aggregate")[0]


@pytest.mark.parametrize("leaf", [1, 3])
def test_exact_split_goes_down_several_levels(ids, monkeypatch, leaf):
    monkeypatch.setattr(sampling, "SPLIT_DIGITS", 1)
    monkeypatch.setattr(sampling, "LEAF_ROWS", leaf)
    got = op.exact_split(ids, "id", 0.2)
    assert got.where("part = 'test'").count() == 1000
    assert op.permute(ids, "id").where("pos <= 1000").select("id").exceptAll(
        got.where("part = 'test'").select("id")
    ).count() == 0


def test_exact_split_of_small_tables(spark):
    for n in (1, 2, 4, 5, 6):
        got = op.exact_split(spark.range(n), "id", 0.2)
        assert got.where("part = 'test'").count() == math.ceil(n / 5)


def test_exact_split_wants_a_unique_key(spark, monkeypatch):
    df = spark.range(1000).selectExpr("0 AS k")
    with pytest.raises(ValueError, match="unique"):
        op.exact_split(df, "k")
    monkeypatch.setattr(sampling, "LEAF_ROWS", 10)
    with pytest.raises(ValueError, match="unique"):
        op.exact_split(df, "k")


def test_exact_split_of_nothing(spark):
    with pytest.raises(ValueError, match="empty"):
        op.exact_split(spark.range(0), "id")


@pytest.mark.parametrize("test", [0, 1, -0.1, 1.5])
def test_impossible_shares(ids, test):
    with pytest.raises(ValueError, match="between"):
        op.hash_split(ids, "id", test)


def test_preview(spark):
    df = spark.range(100).orderBy(F.desc("id"))
    assert column(op.preview(df, "id"), "id") == [0, 1, 2]
    some = op.preview(spark.range(100))
    assert some.count() == 3 and "Sort" not in some._jdf.queryExecution().executedPlan().toString()
