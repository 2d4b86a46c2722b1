"""Experiments that can be gone on with, and the checks of generated data and forests."""

import pytest
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood import sources as src
from wordwood.plans.inspect import final_plan


def log(df):
    return sorted((r["size"], r["stage"], r["trees"] or 0, r["ok"]) for r in df.collect())


def test_a_sweep_goes_on(spark, monkeypatch):
    root, journal = src.scratch_path(spark, "sweep"), src.scratch_path(spark, "journal")
    trained = []
    train = op.forest.train_forest

    def stopping(split, trees, seed):
        trained.append(trees)
        if len(trained) == 2:
            raise KeyboardInterrupt
        return train(split, trees, seed)

    monkeypatch.setattr("wordwood.operators.forest.train_forest", stopping)
    with pytest.raises(KeyboardInterrupt):
        op.forest_sweep(spark, root, [300, 400], (2, 3), journal=journal)
    done = op.forest_sweep(spark, root, [300, 400], (2, 3), journal=journal)
    # The first run was not done again; the one that was killed was.
    assert trained == [2, 3, 3, 2, 3]
    want = [(n, s, t, True) for n in (300, 400) for s, t in (("generate", 0), ("train", 2), ("train", 3))]
    assert log(done) == want
    assert log(op.forest_sweep(spark, root, [300, 400], (2, 3), journal=journal)) == want
    assert len(trained) == 5
    # Another seed is another run.
    op.forest_sweep(spark, root, [300], (2,), seed=7, journal=journal)
    assert len(trained) == 6


def test_failed_runs_are_kept_or_done_again(spark):
    root, journal = src.scratch_path(spark, "sweep"), src.scratch_path(spark, "journal")

    def broken(n):
        raise ValueError("no data")

    failed = [(200, "generate", 0, False), (200, "train", 2, False)]
    assert log(op.forest_sweep(spark, root, [200], (2,), build=broken, journal=journal)) == failed
    assert log(op.forest_sweep(spark, root, [200], (2,), journal=journal)) == failed
    again = op.forest_sweep(spark, root, [200], (2,), journal=journal, retry_failed=True)
    assert log(again) == [(200, "generate", 0, True), (200, "train", 2, True)]
    assert again.where("error IS NOT NULL").count() == 0


def test_text_sweep(spark, monkeypatch):
    root, journal = src.scratch_path(spark, "texts"), src.scratch_path(spark, "journal")
    first = op.text_sweep(spark, root, [1], 4, journal)
    seconds = {r["stage"]: r["seconds"] for r in first.collect()}
    rows = op.text_sweep(spark, root, [1, 2], 4, journal).collect()
    assert {(r["size"], r["stage"]) for r in rows} == {(n, s) for n in (1, 2) for s in ("generate", "count")}
    assert all(r["seconds"] == seconds[r["stage"]] for r in rows if r["size"] == 1)
    counted = {r["size"]: r["counted"] for r in rows if r["stage"] == "count"}
    assert counted == {n: src.text_line_count(n * 2**20) * 1100 for n in (1, 2)}

    def broken(mb):
        raise ValueError("no text\nsecond line")

    rows = op.text_sweep(spark, src.scratch_path(spark, "texts"), [1], build=broken).collect()
    assert [(r["stage"], r["ok"], r["seconds"]) for r in sorted(rows, key=lambda r: r["stage"])] == [
        ("count", False, None), ("generate", False, None)
    ]
    assert {r["error"] for r in rows if r["stage"] == "generate"} == {"no text"}


def test_copies_and_upload_sweeps(spark):
    lines = src.lines_df(spark, ["a b", "c", ""], 2)
    rows = op.copies_sweep(lines, [1, 10, 0], 4).collect()
    assert {r["size"]: r["counted"] for r in rows} == {1: 3, 10: 30, 0: 0}
    root = src.scratch_path(spark, "up")
    rows = op.upload_sweep(spark, root, [50], files=3).collect()
    assert [(r["stage"], r["counted"], r["ok"]) for r in rows] == [("generate", None, True), ("upload", 50, True)]
    assert len(src.read_dataset(spark, src.dataset_path(root, 50)).inputFiles()) == 3

    def broken(n):
        raise ValueError("no rows")

    rows = op.upload_sweep(spark, root, [60], build=broken).collect()
    assert [(r["stage"], r["ok"], r["error"]) for r in rows] == [
        ("generate", False, "no rows"), ("upload", False, "no rows")
    ]


def test_generated_rows_are_as_promised(spark):
    n = 20_000
    assert op.is_classification(src.gen_classification(spark, n))
    assert op.is_classification(src.gen_classification(spark, n, seed=5, sep=2.0, flip=0.2), 2.0, 0.2)
    other = src.gen_classification(spark, n, sep=1.4)
    assert not op.is_classification(other)
    assert any(x.startswith("cov_f0_f1") for x in op.differences(op.distribution(other).collect()))
    assert not op.is_classification(src.gen_classification(spark, n, flip=0.3))
    wide = src.gen_classification(spark, n).withColumn("f3", F.col("f3") * 1.1)
    assert not op.is_classification(wide)
    assert not op.is_classification(src.gen_classification(spark, n).where("label = 0"))
    # Means and covariances as they are, but another shape.
    odd = src.gen_classification(spark, n).withColumn("f3", F.when(F.col("f3") > 0, 1.0).otherwise(-1.0))
    assert any("quantile of f3" in x for x in op.differences(op.distribution(odd).collect()))


def test_one_pass(spark):
    plan = final_plan(op.distribution(src.gen_classification(spark, 1000)))
    assert len(plan.shuffles) == 1 and plan.shuffles[0].partitions == 8


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_walking_the_trees(spark, monkeypatch, broadcast):
    monkeypatch.setattr("wordwood.operators.treewalk.BROADCAST_NODES", broadcast)
    df = src.gen_classification(spark, 2000)
    split = op.hash_split(op.assemble(df), "id")
    model = op.train_forest(split.where("part = 'train'"), num_trees=7, max_depth=4)
    test = split.where("part = 'test'")
    rows = op.walked_alike(model, test).collect()
    assert len(rows) == test.count() and all(r["same"] for r in rows)
    assert {r["prediction"] for r in rows} == {0.0, 1.0}
    # Another forest's nodes do not explain these predictions.
    other = op.train_forest(split.where("part = 'train'"), num_trees=7, max_depth=4, seed=9)
    walked = {r["id"]: r["votes"] for r in op.walk_forest(other, test).collect()}
    own = {r["id"]: r["votes"] for r in op.walk_forest(model, test).collect()}
    assert sum(walked[i] != own[i] for i in own) > len(own) / 2


def test_copies_are_dealt_out_by_bytes(spark):
    long = "word " * 100_000
    df = spark.createDataFrame([(i, "short") for i in range(50)] + [(99, long)], "i long, t string").coalesce(1)
    made = op.replicate(df, 60)
    assert made.rdd.getNumPartitions() == 2
    assert made.groupBy("i").count().where("count <> 60").count() == 0 and made.count() == 51 * 60
    sizes = made.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("t")).alias("n"))
    assert sizes.agg(F.min("n") * 4 > F.max("n")).first()[0]
    few = op.replicate(df.where("i < 50"), 3)
    assert not final_plan(few).shuffles and few.count() == 150
    assert op.replicate(df, 0).count() == 0 and op.replicate(df.limit(0), 5).count() == 0


def test_sample_lines_of_a_table(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    got = [r[0] for r in src.add_sample_lines(df, "x", "y").collect()]
    assert got[0].endswith("Learning a 1") and got[1].endswith("Learning 2")


def test_arrow_on_and_off(spark):
    import pandas as pd

    pdf = pd.DataFrame({"id": [1], "f0": [0.5], "f1": [1.0], "f2": [2.0], "f3": [3.0], "label": [1]})
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(setting)
    frames = [src.from_pandas(spark, pdf, arrow=a) for a in (True, False, None)]
    assert len({(tuple(f.collect()[0]), f.schema.json()) for f in frames}) == 1
    assert spark.conf.get(setting) == before
