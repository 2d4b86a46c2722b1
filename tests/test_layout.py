"""How datasets lie in files: splits, sizes, safe replacement, many sizes in one table."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wordwood import sources as src
from wordwood.plans import QUERIES
from wordwood.plans.inspect import final_plan
from wordwood.sources import datasets
from wordwood.sources.replace import folder


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith(("_", ".")))


def local(path):
    return path.removeprefix("file:")


@pytest.fixture
def path(spark):
    return src.scratch_path(spark, "layout")


def test_splits_follow_the_bytes(spark, path):
    lines = spark.range(40_000).select(F.concat(F.lit("line number "), "id").alias("value"))
    src.write_lines(lines, path, files=8)
    read = src.read_lines(spark, path, splits=24)
    assert 16 <= read.rdd.getNumPartitions() <= 24
    assert not final_plan(read).shuffles
    assert sorted(r[0] for r in read.collect()) == sorted(r[0] for r in lines.collect())
    # Other reads are split as ever.
    assert src.read_lines(spark, path).rdd.getNumPartitions() <= 8
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_small_files_are_read_together(spark, path):
    src.write_lines(spark.range(600).selectExpr("cast(id AS string) AS value"), path, files=60)
    read = src.read_lines(spark, path, splits=6)
    assert 5 <= read.rdd.getNumPartitions() <= 8
    assert read.count() == 600


def test_splits_keep_the_settings(spark, path):
    src.write_lines(spark.range(10).selectExpr("cast(id AS string) AS value"), path)
    read = src.read_lines(spark, path, splits=3)
    assert read.sparkSession.conf.get("spark.sql.shuffle.partitions") == "8"
    assert read.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC"


@pytest.mark.parametrize("row", [40, 100_000])
def test_files_have_the_size(spark, path, row):
    n = 12_000_000 // row
    # Random text, which does not shrink in a file.
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"/{i}")), 512) for i in range(max(1, row // 128))])
    df = spark.range(n).select("id", F.substring(text, 1, row).alias("text")).repartition(3)
    src.write_dataset(df, path, file_bytes=1_000_000)
    sizes = [src.stored_bytes(spark, f"{path}/{f}") for f in files(local(path))]
    assert all(500_000 < s < 2_000_000 for s in sizes)
    assert src.read_dataset(spark, path).count() == n
    lines = src.scratch_path(spark, "lines")
    src.write_lines(df.select("text"), lines, file_bytes=1_000_000)
    sizes = [src.stored_bytes(spark, f"{lines}/{f}") for f in files(local(lines))]
    assert all(500_000 < s < 2_000_000 for s in sizes)


def test_copy_to_files_of_a_size(spark, path):
    src.write_dataset(spark.range(200_000).withColumn("x", F.md5(F.col("id").cast("string"))), path, 9)
    other = src.scratch_path(spark, "other")
    copy = src.copy_dataset(spark, path, other, file_bytes=2_000_000)
    assert copy.count() == 200_000 and 3 <= len(files(local(other))) <= 6


def test_bytes_of_rows(spark):
    df = spark.sql(
        "SELECT 1 AS i, 'é' AS s, array('ab', NULL) AS a, map('k', 2L) AS m, struct(1D AS d, 'x' AS t) AS r,"
        " CAST(NULL AS string) AS n, X'0102' AS b, array(1, 2) AS ints, DATE'2020-01-01' AS d, 1.5BD AS dec"
    )
    want = 4 + 2 + 2 + (1 + 8) + (8 + 1) + 0 + 2 + 8 + 4 + 16
    assert df.select(src.row_bytes(df)).first()[0] == want
    assert src.table_bytes(df.unionAll(df)) == (2, 2 * want)
    assert src.table_bytes(df.limit(0)) == (0, 0) and src.files_of(df.limit(0), 10) == 1
    with pytest.raises(ValueError, match="positive"):
        src.files_of(df, 0)


def test_failed_write_leaves_the_old_rows(spark, path):
    src.write_dataset(spark.range(100), path)
    broken = spark.range(0, 1000, 1, 8).select(
        F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("bigint").alias("id")
    )
    with pytest.raises(PySparkException):
        src.write_dataset(broken, path)
    assert src.read_dataset(spark, path).count() == 100
    with pytest.raises(PySparkException):
        src.write_lines(broken.selectExpr("cast(id AS string) AS value"), path)
    assert src.read_dataset(spark, path).count() == 100
    parent = os.path.dirname(local(path))
    assert not [f for f in os.listdir(parent) if f.startswith(f"_{os.path.basename(path)}")]


def test_a_dataset_can_be_replaced_by_what_it_holds(spark, path):
    src.write_dataset(spark.range(100), path)
    src.write_dataset(src.read_dataset(spark, path).where("id < 10"), path)
    assert src.read_dataset(spark, path).count() == 10


def test_what_was_set_aside_comes_back(spark, path):
    src.write_dataset(spark.range(5), path)
    fs, at = folder(spark, path)
    aside = f"{os.path.dirname(path)}/_{os.path.basename(path)}.old-1"
    assert fs.rename(at, folder(spark, aside)[1])
    df, created = src.ensure_dataset(spark, path, lambda: spark.range(1), rows=5)
    assert not created and df.count() == 5


def test_one_size_is_rewritten_alone(spark, path):
    for n in (10, 200, 3000):
        src.write_size(spark.range(n), path, n)
    before = {n: files(f"{local(path)}/size={n}") for n in (10, 200, 3000)}
    src.write_size(spark.range(7), path, 10)
    assert files(f"{local(path)}/size=10") != before[10]
    assert all(files(f"{local(path)}/size={n}") == before[n] for n in (200, 3000))
    counts = {r["size"]: r["count"] for r in src.read_sizes(spark, path).groupBy("size").count().collect()}
    assert counts == {10: 7, 200: 200, 3000: 3000}
    one = src.read_sizes(spark, path, 200)
    assert final_plan(one).files_read == len(before[200]) and one.count() == 200
    assert src.read_sizes(spark, path, 10, 3000).count() == 3007
    with pytest.raises(ValueError, match="already"):
        src.write_size(spark.range(1).withColumn("Size", F.lit(1)), path, 1)


def test_a_large_size_gets_several_files(spark, path):
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "100k")
    try:
        sizes = F.when(F.col("id") % 10 == 0, 1).otherwise(2)
        df = spark.range(0, 200_000, 1, 8).withColumn("x", F.md5(F.col("id").cast("string")))
        src.write_sizes(df.withColumn("size", sizes), path)
    finally:
        spark.conf.set(setting, before)
    assert len(files(f"{local(path)}/size=2")) > 5
    assert src.read_sizes(spark, path, 2).count() == 180_000


def test_final_plans(spark):
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "24")
    try:
        counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        plan = final_plan(counted)
        (shuffle,) = plan.shuffles
        assert plan.coalesces and not plan.splits_skew
        assert shuffle.partitions == 24 and shuffle.tasks < 24
        # A number that was asked for stays.
        (fixed,) = final_plan(spark.range(1000).repartition(24)).shuffles
        assert (fixed.partitions, fixed.tasks, fixed.coalesced) == (24, 24, False)
    finally:
        spark.conf.set(setting, before)


def test_skew_is_split(spark):
    small = {
        "spark.sql.shuffle.partitions": "24",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
        right = spark.range(0, 300_000, 1, 8).selectExpr("id AS k", "id AS y")
        plan = final_plan(left.join(right, "k"))
        assert plan.splits_skew and "SortMergeJoin" in plan.nodes
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_task_writes_several_of_many_small_files(spark, tmp_path, monkeypatch):
    """Tasks do not become as many as files; the files keep their size, the last of a task too."""
    monkeypatch.setattr(datasets, "MANY_FILES", 40)
    path = str(tmp_path / "small")
    src.write_dataset(spark.range(0, 200_000, 1, 7).selectExpr("id", "md5(string(id)) AS m"), path, file_bytes=128 << 10)
    rows = src.read_dataset(spark, path).groupBy("_metadata.file_path", "_metadata.file_size").count().collect()
    tasks = {r["file_path"].rsplit("/", 1)[1].split("-")[1] for r in rows}
    assert sum(r["count"] for r in rows) == 200_000
    assert len(rows) >= 40 and len(rows) >= 8 * len(tasks)
    assert all(64 << 10 <= r["file_size"] <= 256 << 10 for r in rows)


def test_files_by_bytes_lists_no_file_alone(spark, sf_dir, monkeypatch):
    def listed(*_):
        raise AssertionError("one listing for each file")

    monkeypatch.setattr(src, "stored_bytes", listed)
    got = QUERIES["files_by_bytes"](spark, sf_dir).collect()
    assert [(r["name"], r["even"]) for r in got] == [(n, True) for n in ("documents", "orders", "lineitem")]
    assert [r["n"] for r in got] == [spark.read.parquet(f"{sf_dir}/{r['name']}.parquet").count() for r in got]
