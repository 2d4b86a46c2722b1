import glob
import os
import subprocess
import sys

import pandas as pd
import pytest
from conftest import ROOT
from helpers import column
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from wordwood import operators as op
from wordwood import sources as src
from wordwood.functions import files_for
from wordwood.sources import datasets, scratch


def files(path, kind="parquet"):
    return sorted(glob.glob(f"{path}/part-*{kind}"))


@pytest.mark.parametrize("n", [1, 4, 24])
def test_exact_file_count(spark, tmp_path, n):
    path = str(tmp_path / "data")
    src.write_dataset(spark.range(10_000), path, n)
    assert len(files(path)) == n
    assert src.read_dataset(spark, path).count() == 10_000


def test_overwrite(spark, tmp_path):
    path = str(tmp_path / "data")
    src.write_dataset(spark.range(10), path, 4)
    src.write_dataset(spark.range(5), path, 2)
    assert len(files(path)) == 2
    assert sorted(column(src.read_dataset(spark, path), "id")) == [0, 1, 2, 3, 4]


def test_read_with_schema_prunes(spark, tmp_path):
    path = str(tmp_path / "data")
    src.write_dataset(src.gen_classification(spark, 100), path)
    df = src.read_dataset(spark, path, src.FEATURE_SCHEMA)
    assert df.schema == src.FEATURE_SCHEMA
    plan = df.select("f1").where("label = 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<f1:float,label:int>" in plan
    assert "EqualTo(label,1)" in plan


def test_copy(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    src.write_dataset(spark.range(1000), a, 7)
    copy = src.copy_dataset(spark, a, b, 4)
    assert len(files(b)) == 4
    assert copy.exceptAll(src.read_dataset(spark, a)).count() == 0
    assert src.copy_dataset(spark, a, c).count() == 1000


def test_ensure_builds_once(spark, tmp_path):
    path = src.dataset_path(str(tmp_path), 100)
    calls = []

    def build():
        calls.append(1)
        return spark.range(100)

    first, created = src.ensure_dataset(spark, path, build, 2)
    written = files(path)
    again, created_again = src.ensure_dataset(spark, path, build, 2)
    assert (created, created_again, len(calls)) == (True, False, 1)
    assert files(path) == written
    assert first.count() == again.count() == 100


def test_ensure_replaces_an_aborted_write(spark, tmp_path):
    path = tmp_path / "data"
    (path / "_temporary").mkdir(parents=True)
    df, created = src.ensure_dataset(spark, str(path), lambda: spark.range(3))
    assert created and df.count() == 3


def test_half_a_dataset_is_not_a_dataset(spark, tmp_path):
    """Neither read as whole nor overwritten: an error that names the folder."""
    path = tmp_path / "data"
    src.write_dataset(spark.range(100), str(path), 4)
    (path / "_SUCCESS").unlink()
    os.remove(files(path)[0])
    with pytest.raises(ValueError, match="_SUCCESS"):
        src.ensure_dataset(spark, str(path), lambda: spark.range(3))
    assert len(files(path)) == 3


def test_ensure_looks_at_the_rows(spark, tmp_path):
    path = str(tmp_path / "data")
    src.ensure_dataset(spark, path, lambda: spark.range(100), 4, rows=100)
    assert src.ensure_dataset(spark, path, lambda: spark.range(100), rows=100)[1] is False
    os.remove(files(path)[0])
    with pytest.raises(ValueError, match="75 rows, not 100"):
        src.ensure_dataset(spark, path, lambda: spark.range(100), rows=100)


def test_ensure_does_not_overwrite_other_files(spark, tmp_path):
    path = tmp_path / "data"
    path.mkdir()
    (path / "part-0.parquet").write_bytes(b"this is not parquet")
    with pytest.raises(ValueError, match="foreign"):
        src.ensure_dataset(spark, str(path), lambda: spark.range(3))
    assert (path / "part-0.parquet").read_bytes() == b"this is not parquet"


def test_missing_path_is_an_error_when_reading(spark, tmp_path):
    with pytest.raises(AnalysisException):
        src.read_dataset(spark, str(tmp_path / "nothing"))


def test_paths():
    assert src.dataset_path("/d/", 100_000) == "/d/data_100000"
    assert src.dataset_path("hdfs://h/d", 5, ".parquet") == "hdfs://h/d/data_5.parquet"


def test_file_policy():
    assert [files_for(n) for n in (100_000, 4_999_999, 5_000_000, 1_000_000_000)] == [24, 24, 48, 48]
    assert files_for(10**12) == 47_620
    assert datasets.TABLE_SIZES[-1] == 4_000_000


def test_lines_df(spark):
    df = src.lines_df(spark, ["a b", "", "c"], 24)
    assert df.columns == ["value"] and df.rdd.getNumPartitions() == 24
    assert sorted(column(df, "value")) == ["", "a b", "c"]


@pytest.mark.parametrize("arrow", ["true", "false"])
def test_from_pandas_has_one_schema(spark, arrow):
    pdf = pd.DataFrame({"label": [0, 1], "f0": [0.5, 1.5], "f1": [1.0, 2.0], "id": [1, 2]})
    pdf = pdf.assign(f2=pdf.f0, f3=pdf.f1)
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, arrow)
    try:
        df = src.from_pandas(spark, pdf)
        assert df.schema == src.FEATURE_SCHEMA
        assert sorted(map(tuple, df.collect()))[0] == (1, 0.5, 1.0, 0.5, 1.0, 0)
    finally:
        spark.conf.set(key, before)


def test_text_round_trip(spark, tmp_path):
    path = str(tmp_path / "text")
    lines = ["a b", "", "  c", "é"]
    src.write_lines(src.lines_df(spark, lines, 2), path, 2)
    assert len(files(path, "txt")) == 2
    assert sorted(column(src.read_lines(spark, path, 3), "value")) == sorted(lines)


def test_a_scan_is_not_shuffled(spark, sf_dir, tmp_path):
    """The number of cores or splits changes no plan."""
    path = str(tmp_path / "text")
    src.write_lines(spark.range(100).selectExpr("'a b' AS value"), path, 2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(src.read_lines(spark, path))
    documents = src.read_dataset(spark, f"{sf_dir}/documents.parquet")
    assert plan(op.word_counts(documents)).count("Exchange") == 1
    assert "RoundRobin" not in plan(op.word_counts(documents))


def test_scratch_is_in_the_folder_of_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = src.scratch_path(spark, "x"), src.scratch_path(spark, "x")
    assert a.startswith(root) and a != b


class Unset:
    """Stands for a session on some master whose checkpoint folder is not set."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master = master
        self.folder = None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = f"file:{path}/app"


def test_scratch_without_a_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Unset("spark://host:7077"))
    local = Unset("local[2]")
    assert scratch.scratch_root(local) == scratch.scratch_root(local) == local.folder


def test_scratch_in_a_plain_local_session(sf_dir):
    """A session of its own, in which nothing is set: queries that write must still run."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from wordwood.plans import QUERIES
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", QUERIES["line_scan_roundtrip"](spark, {sf_dir!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0


def test_drop_path(spark):
    gone, kept = src.scratch_path(spark, "tables"), src.scratch_path(spark, "tables")
    for path in (f"{gone}/one", f"{gone}/two", kept):
        src.write_dataset(spark.range(3), path)
    src.drop_path(spark, gone)
    for name in ("one", "two"):
        with pytest.raises(AnalysisException):
            src.read_dataset(spark, f"{gone}/{name}")
    assert src.read_dataset(spark, kept).count() == 3
    with pytest.raises(ValueError):
        src.drop_path(spark, "/somewhere/else")


def test_drop_scratch(spark):
    path = src.scratch_path(spark, "gone")
    src.write_dataset(spark.range(3), path)
    src.drop_scratch(spark)
    with pytest.raises(AnalysisException):
        src.read_dataset(spark, path)


def test_feature_schema_names():
    assert src.FEATURE_SCHEMA.names == ["id", *src.FEATURE_COLS, "label"]
    assert src.FEATURE_SCHEMA["label"].dataType == T.IntegerType()
