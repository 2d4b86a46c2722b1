import pytest
from helpers import column
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood import sources as src
from wordwood.operators import forest


@pytest.fixture(scope="module")
def split(spark):
    data = op.assemble(src.gen_classification(spark, 20_000))
    return op.hash_split(data, "id").cache()


@pytest.fixture(scope="module")
def model(split):
    return op.train_forest(split.where("part = 'train'"))


def test_defaults(model):
    assert model.getNumTrees == 20
    assert model.getOrDefault("maxDepth") == 5
    assert model.numClasses == 2


def test_accuracy_on_unseen_rows(model, split):
    row = op.evaluate_forest(model, split).first()
    assert row["n_train"] + row["n_test"] == 20_000
    assert row["accuracy_pct"] > 88


def test_noise_matters_least(model):
    importances = model.featureImportances.toArray()
    assert importances.argmin() == 3 and importances[3] < 0.02


def test_accuracy_is_that_of_the_evaluator(model, split):
    scored = op.score(model, split.where("part = 'test'"))
    assert {"rawPrediction", "probability", "prediction"} <= set(scored.columns)
    theirs = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
    assert op.accuracy_pct(scored).first()[0] == pytest.approx(100 * theirs)
    assert op.evaluate_forest(model, split).first()[2] == pytest.approx(100 * theirs)


def test_more_separation_is_easier(spark):
    got = []
    for sep in (1.0, 2.0):
        data = op.assemble(src.gen_classification(spark, 8_000, sep=sep))
        rows = op.hash_split(data, "id").cache()
        model = op.train_forest(rows.where("part = 'train'"))
        got.append(op.evaluate_forest(model, rows).first()["accuracy_pct"])
    assert got[0] < 85 < 93 < got[1]


def test_a_small_table_tiled_and_shuffled(spark):
    """Three flower-like classes of fifty rows, made large, shuffled and learnt."""
    base = spark.range(150).selectExpr(
        "id AS k", "cast(id div 50 as int) AS label",
        *[f"cast(id div 50 * {i + 1} + (id * {i + 3}) % 7 / 10.0 as float) AS f{i}" for i in range(4)],
    )
    tiled = op.permute(op.tile(base, "k", 10_000), "id")
    classes = dict(map(tuple, tiled.groupBy("label").count().collect()))
    assert classes == {0: 3350, 1: 3350, 2: 3300}
    rows = op.assemble(op.conform(tiled))
    split = op.exact_split(rows, "id").cache()
    model = op.train_forest(split.where("part = 'train'"))
    assert model.numClasses == 3
    row = op.evaluate_forest(model, split).first()
    assert (row["n_train"], row["n_test"]) == (8_000, 2_000)
    assert row["accuracy_pct"] > 99


def test_train_without_a_split(spark):
    rows = op.assemble(src.gen_classification(spark, 4_000))
    model = op.train_forest(rows, num_trees=30)
    assert model.getNumTrees == 30
    assert op.accuracy_pct(op.score(model, rows)).first()[0] > 88
    whole = rows.withColumn("part", F.lit("train"))
    assert op.evaluate_forest(model, whole).first()["accuracy_pct"] is None


@pytest.mark.parametrize("labels", [(0, 2), (1, 2), (0, 0.5), (0, None), (-1, 0)])
def test_labels_must_be_without_a_gap(spark, labels):
    rows = [(i, 0.0, 1.0, 2.0, 3.0, None if y is None else float(y)) for i, y in enumerate(labels)]
    df = spark.createDataFrame(
        rows, "id long, f0 double, f1 double, f2 double, f3 double, label double"
    )
    with pytest.raises(ValueError, match="0..k-1"):
        op.train_forest(op.assemble(df))


def test_conform(spark):
    df = spark.createDataFrame(
        [(1, 0.1, 0.2, 0.3, 0.4, 1, "x")],
        "id int, f0 double, f1 double, f2 double, f3 double, label long, more string",
    )
    assert op.conform(df).schema == src.FEATURE_SCHEMA


def test_null_features_are_an_error(spark):
    df = spark.createDataFrame([(None, 1.0)], "f0 double, f1 double")
    with pytest.raises(Exception, match="null while assembling"):
        op.assemble(df, ["f0", "f1"]).collect()


def test_document_features(spark):
    texts = ["Ab c ab c", "", None, "123 é", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: tuple(r)[1:] for r in op.document_features(df).collect()}
    assert got[0] == pytest.approx((9, 4, 6 / 9, 3 / 4))
    assert got[1] == got[2] == (0, 0, 0, 0)
    assert got[3] == (5, 2, 0, 1)
    assert got[4] == (3, 0, 0, 0)


def test_sweep(spark, tmp_path):
    got = op.forest_sweep(spark, str(tmp_path), [500, 1000], trees=(5, 10))
    assert [(r["size"], r["stage"], r["trees"]) for r in got.collect()] == [
        (500, "generate", None), (500, "train", 5), (500, "train", 10),
        (1000, "generate", None), (1000, "train", 5), (1000, "train", 10),
    ]
    assert got.schema.fields[:7] == op.RUN_LOG_SCHEMA.fields
    summary = op.stage_summary(got.drop("trees"), ["generate", "train"], agg="max").collect()
    assert all(r["generate"] > 0 and r["train"] > 0 and r["other"] is None for r in summary)
    assert set(column(got, "ok")) == {True}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["data_1000", "data_500"]


def test_sweep_as_a_matrix(spark, tmp_path):
    """A sweep is a run log as well: accuracy by size and number of trees."""
    sweep = op.forest_sweep(spark, str(tmp_path), [600], trees=(3, 6)).cache()
    got = op.run_matrix(sweep.where("stage = 'train'"), "size", "trees", [3, 6], "accuracy_pct", "trees_")
    want = {r["trees"]: r["accuracy_pct"] for r in sweep.collect()}
    assert list(map(tuple, got.collect())) == [(600, want[3], want[6], None)]


def test_sweep_on_all_rows(spark, tmp_path):
    row = op.forest_sweep(spark, str(tmp_path), [400], trees=(3,), test=None).where("stage = 'train'").first()
    assert (row["n_train"], row["n_test"], row["accuracy_pct"]) == (400, 0, None)


def test_failed_run_is_marked(spark, tmp_path, monkeypatch):
    def fail(*args):
        raise PySparkException("lost\nmore")

    monkeypatch.setattr(forest, "train_forest", fail)
    row = op.forest_sweep(spark, str(tmp_path), [300], trees=(3,)).where("stage = 'train'").first()
    assert (row["ok"], row["error"]) == (False, "lost")
    assert row["seconds"] is row["accuracy_pct"] is row["n_test"] is None


def test_a_dataset_that_cannot_be_made_is_a_row(spark, tmp_path):
    def build(n):
        if n == 300:
            raise PySparkException("no data")
        return src.gen_classification(spark, n)

    got = op.forest_sweep(spark, str(tmp_path), [200, 300, 400], trees=(3,), build=build).collect()
    assert [(r["size"], r["stage"], r["ok"]) for r in got] == [
        (200, "generate", True), (200, "train", True),
        (300, "generate", False), (300, "train", False),
        (400, "generate", True), (400, "train", True),
    ]
    assert {r["error"] for r in got if not r["ok"]} == {"no data"}


def test_a_constant_prediction_does_not_beat_the_majority(spark, model, split):
    rows = split.select("label", F.lit(1.0).alias("prediction"))
    assert op.beats_majority(rows).first()["beats_majority"] is False
    good = op.beats_majority(op.score(model, split)).first()
    assert good["beats_majority"] is True and 49 < good["majority_pct"] < 55 and good["n"] == 20_000


def test_each_pass_reads_one_part(spark):
    split = op.written_split(src.gen_classification(spark, 500))
    plan = split.where("part = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "md5" not in plan and "part#" in plan.split("PartitionFilters")[1]
    assert split.count() == 500
