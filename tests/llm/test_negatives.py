import math
import random
from collections import Counter

import numpy as np
import pytest

from wordwood.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, place string, block string"


def takes_part(i, v, label):
    ok = v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    return ok and sum(math.floor(256 * x) ** 2 for x in v) < 2**62


def brute(rows):
    """What is to be found, from all scores of all anchors."""
    known = [
        (i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label)
        for i, v, label in rows
        if takes_part(i, v, label)
    ]
    out = Counter()
    for a, (anchor, q, own) in enumerate(known):
        if anchor is None or anchor % 100:
            continue
        scores = [
            (-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i or 0, label)
            for b, (i, v, label) in enumerate(known)
            if b != a
        ]
        scores.sort()
        for p, p_null, p_id, _ in [s for s in scores if s[3] == own][:5]:
            inside = [s for s in scores if s[3] != own and 30 * -p <= 100 * -s[0] <= 90 * -p]
            for rank, (n, n_null, n_id, _) in enumerate(inside[:10], 1):
                out[anchor, None if p_null else p_id, rank, None if n_null else n_id, -p, -n] += 1
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def close(rng, n, dims=16, labels=3):
    """Vectors around a few centres, so that windows hold rows of other labels."""
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        mix = centres[rng.randrange(labels)] if rng.random() < 0.5 else centres[label]
        rows.append((i * 10, [c * 0.5 + rng.gauss(0, 0.4) for c in mix], label))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_scores(spark, monkeypatch, seed):
    if seed == 2:
        for name, value in (("BLOCK_ROWS", 32), ("CELL_ROWS", 50), ("CELL_ANCHORS", 7), ("COLUMNS_AT_ONCE", 3)):
            monkeypatch.setattr(negatives, name, value)
    rows = close(random.Random(seed), 400)
    want = brute(rows)
    assert len(want) > 500
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = close(rng, 120, dims=6)
    rows += [(100, rows[3][1], 1), (100, rows[3][1], 1), (200, rows[4][1], 2)]
    rows += [(i, list(rows[5][1]), rng.randrange(3)) for i in range(3001, 3060)]
    rows += [(None, rows[5][1], 0), (None, rows[5][1], 1), (None, None, None)]
    rows += [(4000, None, 1), (4100, [0.1] * 6, None), (4200, [0.1, None, 0.2], 1)]
    rows += [(4300, [0.1, math.nan], 1), (4400, [math.inf], 1), (4500, [-math.inf], 1)]
    rows += [(4600, [], 1), (4700, [0.0] * 6, 2), (4800, [0.3, -0.2], 0), (4900, [0.2] * 9, 1)]
    rows += [(5000, [3e5, -2e5], 0), (5100, [3e5, -2e5, 1.0], 0), (5200, [2.9e5, -1.0], 1), (5300, [1e30], 1)]
    rows += [(-100, [-0.4] * 6, 1), (-7, [0.4] * 6, 9)]
    assert found(spark, rows) == brute(rows)


def test_one_label_and_empty_table(spark):
    rows = [(i, [float(i), 1.0], 5) for i in range(1, 300) if i % 7]
    assert found(spark, rows) == Counter()
    assert found(spark, []) == Counter()
    assert found(spark, [(100, [1.0], 1)]) == Counter()


def test_most_columns_are_skipped():
    """Vectors with few large components: the rest need not be read."""
    rng = np.random.default_rng(1)
    columns = rng.integers(-3, 4, (64, 3000))
    columns[:4] = rng.integers(-250, 250, (4, 3000))
    row = type("Row", (), {})()
    row.ids = np.zeros((3000, 2), np.int64).tobytes()
    row.labels, row.block, row.n, row.kind = np.zeros(3000, np.int64).tobytes(), 0, 3000, "<i8"
    row.columns = columns.astype(np.int64).tobytes()
    block = negatives.Block(row)
    seen = []

    def prune(lower, upper):
        seen.append(len(lower))
        return upper >= negatives._kth_largest(lower, 5)

    left, scores = block.scores(columns[:, 7].astype(np.int64), np.arange(3000), prune)
    want = np.sort(columns[:, 7] @ columns)[-5:]
    assert sorted(scores)[-5:] == want.tolist() and len(left) < 50
    assert seen[0] == 3000 and seen[1] < 300


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    want = brute([tuple(r) for r in rows.collect()])
    got = queries.op13_hard_negatives(spark, sf_dir).collect()
    assert Counter(tuple(r) for r in got) == want and want
