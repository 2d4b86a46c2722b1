from collections import Counter

import pytest
from helpers import as_dict, column
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood import sources as src
from wordwood.sources import generate
from wordwood.sources.datasets import TEXT_SIZES_MB


def replayed_line_count(target_mb):
    """Batches of 1000 lines while more than a batch is missing, then single lines."""
    target, size, n = target_mb * generate.MB, 0, 0
    while size < target:
        step = 1000 if target - size > 1000 * generate.LINE_BYTES else 1
        size, n = size + step * generate.LINE_BYTES, n + step
    return n


@pytest.mark.parametrize("mb", [1, 10, *TEXT_SIZES_MB])
def test_line_count_is_that_of_the_loop(mb):
    assert src.text_line_count(mb * generate.MB) == replayed_line_count(mb)


def test_known_line_counts():
    got = [src.text_line_count(mb * generate.MB) for mb in TEXT_SIZES_MB]
    assert got == [7943, 31771, 79426, 162664, 243996]


def test_gen_text(spark, tmp_path):
    text = src.gen_text(spark, 1)
    path = str(tmp_path / "text")
    src.write_lines(text, path, 3)
    back = src.read_lines(spark, path, 24)
    assert back.count() == 159
    assert back.rdd.getNumPartitions() == 24
    assert op.text_size_mb(back, "value").first()["size_mb"] * generate.MB == 1_049_559
    assert op.token_total(back, "value").first()["tokens"] == 174_900
    assert set(as_dict(op.word_counts(back, "value")).values()) == {15_900}


def test_sample_lines(spark):
    counts = as_dict(op.word_counts(src.gen_sample_lines(spark), "value", "space"))
    assert len(counts) == 11
    assert counts.pop("Hello") == 20_000
    assert set(counts.values()) == {10_000}


@pytest.fixture(scope="module")
def data(spark):
    return src.gen_classification(spark, 20_000).cache()


def test_classification_shape(data):
    assert [(f.name, f.dataType) for f in data.schema] == [
        (f.name, f.dataType) for f in src.FEATURE_SCHEMA
    ]
    assert sorted(column(data, "id")) == list(range(20_000))
    assert abs(data.agg(F.avg("label")).first()[0] - 0.5) < 0.02


def test_classification_does_not_depend_on_partitions(spark, data):
    again = src.add_classification(spark.range(20_000).repartition(3), "id")
    assert again.exceptAll(data).count() == 0
    assert src.gen_classification(spark, 20_000, seed=7).exceptAll(data).count() > 19_000


def test_classification_distribution(data):
    """Unit variance around the corners; the noise column is standard normal."""
    stats = data.withColumn("c", F.col("id") % 4).groupBy("c").agg(
        *[F.avg(f"f{i}").alias(f"m{i}") for i in range(4)],
        *[F.stddev(f"f{i}").alias(f"s{i}") for i in range(4)],
    )
    corners = {0: (1, 1, 1), 1: (1, -1, 1), 2: (-1, -1, -1), 3: (-1, 1, 1)}
    for r in stats.collect():
        for i in range(4):
            center = 1.5 * corners[r["c"]][i] if i < 3 else 0.0
            assert abs(r[f"m{i}"] - center) < 0.08
            assert abs(r[f"s{i}"] - 1) < 0.05


def test_flipped_labels(data):
    wrong = data.where("label <> id % 2").count()
    assert 50 <= wrong <= 150


def test_no_single_axis_tells_the_label(data):
    for i in range(4):
        hit = data.select(F.avg((F.col("label") == (F.col(f"f{i}") > 0).cast("int")).cast("int")))
        assert 0.2 < hit.first()[0] < 0.8


def test_features_do_not_follow_the_split(data):
    """The generator and the splits must not use the same hash of the key."""
    parts = op.hash_split(data, "id").groupBy("part").agg(
        *[F.stddev(f"f{i}").alias(f"s{i}") for i in range(4)], F.avg("label").alias("y")
    )
    train, test = sorted(parts.collect(), key=lambda r: r["part"], reverse=True)
    for i in range(4):
        assert abs(train[f"s{i}"] - test[f"s{i}"]) < 0.05
    assert abs(train["y"] - test["y"]) < 0.03


def test_words_of_the_phrase():
    assert Counter(generate.PHRASE.split()).total() == 11
    assert len(generate.PHRASE) == 66
    assert len(generate.SAMPLE_LINE.split()) == 12
