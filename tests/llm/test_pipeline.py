from collections import Counter

import corpus_pipeline
import pytest
from llm.test_jaccard import plain as plain_groups
from llm.test_leaks import plain as plain_leaks
from llm.test_mixing import plain_targets, size_of
from llm.test_sharding import plain_shard

from wordwood.llm import classifier, mixing, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """What each stage gets and gives, over the documents of the small tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf_dir).write.parquet(out)
        after = spark.read.parquet(out)
        done[name] = docs, after
        docs = after
    return done


def test_quality(spark, sf_dir, stages):
    docs, after = stages["quality_classifier"]
    net = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.collect()
    scores = net.score([r.text for r in rows])
    want = [tuple(r) for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert after.columns == COLUMNS and rows_of(after) == sorted(want, key=str)
    assert 0 < len(want) < len(rows)


def test_near_duplicates(stages):
    docs, after = stages["ngram_jaccard_join"]
    rows = [tuple(r) for r in docs.collect()]
    want = [r for r, (i, _, c) in zip(rows, plain_groups(rows), strict=True) if i == c]
    assert after.columns == COLUMNS and rows_of(after) == sorted(want, key=str)
    assert len(want) < len(rows)


def test_decontamination(spark, sf_dir, stages):
    docs, after = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    bad = {i for i, _ in plain_leaks([r[:3] for r in rows], items)}
    assert bad and rows_of(after) == sorted((r for r in rows if r[0] not in bad), key=str)


def test_mixing(stages):
    docs, after = stages["mixing"]
    rows = docs.collect()
    counts = Counter(map(tuple, after.collect()))
    assert after.columns == COLUMNS and set(counts) <= set(map(tuple, rows))
    assert max(counts.values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += size_of(r.text)
        taken[r.source] += size_of(r.text) * counts[tuple(r)]
    largest = max(size_of(r.text) for r in rows)
    for s, target in plain_targets(sizes).items():
        assert abs(taken[s] - target) <= largest / 2 + 1
    plan = mixing.mix(docs, whole=True).collect()
    assert {r.doc_id: r.times for r in plan if r.times} == {k[0]: n for k, n in counts.items()}


def test_sharding(stages):
    docs, after = stages["sharding"]
    want = Counter(
        (i, plain_shard(i, sharding.EIGHT), plain_shard(i, sharding.grown(sharding.EIGHT)))
        for (i,) in docs.select("doc_id").collect()
    )
    assert want == Counter((r.doc_id, r.shard, r.grown_shard) for r in after.collect())


def test_run_is_all_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    _, want = stages["sharding"]
    assert rows_of(got) == rows_of(want)


def test_an_empty_table_goes_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
