import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from llm.helpers import CLASHING, SCHEMA, odd_rows, table

from wordwood.llm import mixing


def size_of(text):
    return len((text or "").encode().split())


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """Fill all sources at the same speed per weight, one full source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, given = share * sum(sizes.values()), {}
    open_ = [s for s in names if sizes[s] > 0]
    for s in names:
        given[s] = 0.0
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if epochs * sizes[s] <= level * weight[s]]
        if not full:
            for s in open_:
                given[s] = level * weight[s]
            break
        for s in full:
            given[s] = epochs * sizes[s]
            left -= given[s]
            open_.remove(s)
    return given


def test_odd_rows(spark):
    rows = odd_rows()
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    pairs = Counter((r.doc_id, r.size) for r in got)
    assert pairs == Counter((i, size_of(t)) for i, t, _ in rows)


def test_the_order_is_that_of_the_digests(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "ab"[i % 2]) for i in range(200)]
    got = {r.doc_id: r.taken for r in mixing.mix(table(spark, rows)).collect()}
    for s in "ab":
        own = [(i, t) for i, t, x in rows if x == s]
        size = sum(size_of(t) for _, t in own)
        budget = int(plain_targets({x: sum(size_of(t) for _, t, y in rows if y == x) for x in "ab"})[s] + 0.5)

        def place(row):
            digest = hashlib.md5(row[1].encode()).hexdigest()
            return hashlib.md5(f"{row[0]}/{digest}/0/42".encode()).hexdigest()

        rest = budget - budget // size * size
        for i, t in sorted(own, key=place):
            last = max(0, min(size_of(t), rest))
            assert got[i] == budget // size * size_of(t) + last
            rest -= size_of(t)


def test_reruns_and_partitionings_agree(spark):
    df = table(spark, odd_rows())
    first, second = mixing.mix(df), mixing.mix(df.repartition(7))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_a_source_below_its_bound_keeps_below(spark):
    # Weights 5, 2, 1: the first fills up, the others share what is left over.
    sizes = {"a": 10, "b": 400, "c": 400}
    want = plain_targets(sizes)
    assert want["a"] == 20
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    df = table(spark, [(i, "w", s) for i, (_, s) in enumerate(rows)])
    got = mixing.mix(df).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in got} == {s: int(t + 0.5) for s, t in want.items()}


def test_empty_tables_and_sources_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r.taken, r.target) for r in got} == {(0, 0.0)}


def test_mixed_documents_keeps_columns_and_counts(spark):
    rows = odd_rows() + [(i, "x y z", "c") for i in range(100, 160)]
    df = table(spark, rows)
    plan = mixing.mix(df, whole=True).groupBy("doc_id", "source", "text_md5").sum("times").collect()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and set(CLASHING) <= set(out.columns)
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    got = Counter((r.doc_id, r.source, md5(r.text)) for r in out.collect())
    want = Counter({(r[0], r[1], r[2]): r[3] for r in plan})
    assert got == +want


def test_many_equal_rows_share_the_budget(spark):
    rows = [(1, "same words here", "a")] * 300 + [(i, "w", "b") for i in range(10, 20)]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == 310
    taken = sum(r.taken for r in got if r.doc_id == 1)
    assert abs(taken - plain_targets({"a": 900, "b": 10})["a"]) <= 0.5


def test_rows_that_differ_in_another_column_all_stay(spark):
    rows = [(1, "same words here", lang, "a", 3) for lang in ("en", "de", None) for _ in range(2)]
    rows += [(i, "x y z w", "en", "b", 7) for i in range(10, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_md5", "_last", "_times", "_id", "_copy", "_rounds", "_source", "_row"):
        df = df.withColumn(name, F.lit("mine"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter(r.lang for r in out.where("doc_id = 1").collect())
    # The source gets twice its size: each row comes twice.
    assert got == {"en": 4, "de": 4, None: 4}
    assert {r["_md5"] for r in out.collect()} == {"mine"}


def test_very_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_PER_BLOCK", 7)
    df = table(spark, [(1, "w", "a")] * 50)
    assert mixing.mixed_documents(df, share=4.0, epochs=4).count() == 200
