import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from llm.helpers import SCHEMA, odd_rows, prose, table, vocabulary

from wordwood.llm import lm


def words(text):
    w = (text or "").encode().lower().split()
    return [b"\x00start", *w, b"\x00end"] if w else []


def plain(rows, target):
    pairs, first, known = [Counter(), Counter()], [Counter(), Counter()], set()
    for side, texts in enumerate([[t for _, t, *_ in rows], target]):
        for text in texts:
            w = words(text)
            known.update(w[1:-1])
            pairs[side].update(zip(w, w[1:], strict=False))
            first[side].update(w[:-1])
    v = len(known) + 1
    # The end is as frequent as the beginning, which is the first of two.
    totals = [sum(first[s].values()) for s in (0, 1)]
    out = []
    for i, text, *_ in rows:
        w = words(text)
        if not w:
            out.append((i, 0, None, None))
            continue
        loss = [
            -sum(
                (1 - lm.ALONE) * math.log((pairs[s][a, b] + lm.MU / v) / (first[s][a] + lm.MU))
                + lm.ALONE * math.log((first[s][a] + lm.MU / v) / (totals[s] + lm.MU))
                for a, b in zip(w, w[1:], strict=False)
            ) / (len(w) - 1)
            for s in (1, 0)
        ]
        out.append((i, len(w) - 2, *loss))
    return out


def check(spark, rows, target):
    aim = spark.createDataFrame([(t, "clash") for t in target], "text string, word string")
    got = lm.score(table(spark, rows), aim).collect()
    order = lambda r: (str(r[0]), r[1], r[2] or 0.0)
    want = sorted(plain(rows, target), key=order)
    assert len(got) == len(want)
    for r, (i, n, t, b) in zip(sorted(got, key=order), want, strict=True):
        assert (r.doc_id, r.n_words) == (i, n)
        if n:
            assert r.target_loss == pytest.approx(t) and r.background_loss == pytest.approx(b)
            assert r.score == pytest.approx(t - b)
        else:
            assert r.target_loss is r.background_loss is r.score is None


def some(seed, n):
    rng, vocab = random.Random(seed), vocabulary(seed, 60)
    return [(i, prose(rng, vocab, rng.randint(1, 50)).title(), "a") for i in range(n)]


def test_odd_rows_against_plain(spark):
    rows = odd_rows() + some(1, 60) + some(1, 20)
    check(spark, rows, [t for _, t, _ in some(1, 10)] + [None, "", "one two three"])


@pytest.mark.parametrize("share,at_once", [(3, 40), (10**9, 40), (3, 2_000_000)])
def test_hot_words_and_small_batches(spark, monkeypatch, share, at_once):
    monkeypatch.setattr(lm, "HOT_SHARE", share)
    monkeypatch.setattr(lm, "BIGRAMS_AT_ONCE", at_once)
    rows = [(i, "the cat the dog the the end", "a") for i in range(30)] + some(2, 30)
    check(spark, rows, ["the cat", "a dog"])


def test_empty_tables(spark):
    aim = spark.createDataFrame([], "text string")
    assert lm.score(spark.createDataFrame([], SCHEMA), aim).collect() == []
    check(spark, some(3, 10), [])


def test_target_like_texts_score_low(spark):
    near, far = some(4, 40), [(100 + i, t, s) for i, t, s in some(5, 40)]
    aim = spark.createDataFrame([(t,) for _, t, _ in some(4, 80)[40:]], "text string")
    got = {r.doc_id: r.score for r in lm.score(table(spark, near + far), aim).collect()}
    assert sum(got[i] for i in range(40)) < sum(got[i] for i in range(100, 140)) - 40


@pytest.mark.parametrize("text,copies", [("hello world", 1), ("hello world", 5_000), ("a", 3)])
def test_few_different_bigrams(spark, text, copies):
    check(spark, [(i, text, "a") for i in range(copies)], [text])


def test_frequent_bigrams_are_not_sent(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    whole = lm._losses

    def watched(rows, *others):
        seen.add(sum(len(p) // 8 for p in rows["pairs"]))
        return whole(rows, *others)

    monkeypatch.setattr(lm, "_losses", watched)
    rows = [(i, "the the the the the the the the", "a") for i in range(2_000)] + some(6, 20)
    check(spark, rows, ["the the", *(t for _, t, _ in some(7, 10))])
    # Of 18,000 bigrams of the copies only those that are rare would go to a fragment.
    assert seen.value < 3_000


def test_a_fragment_gets_only_what_is_there(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_FRAGMENTS", 500)
    sizes = spark.sparkContext.accumulator(0)
    whole = lm._losses

    def watched(rows, *others):
        out = whole(rows, *others)
        sizes.add(sum(len(b) for b in rows["counts"]) + sum(len(b) for b in out["sums"]))
        return out

    monkeypatch.setattr(lm, "_losses", watched)
    rows = [(i, f"word{i} other{i}", "a") for i in range(400)]
    check(spark, rows, ["word1 other1"])
    # Three bigrams a text, each with a number and two sums; not 500 fragments with all texts.
    assert sizes.value <= 400 * 3 * 20


def test_words_that_share_half_of_their_hash(spark):
    """``w6164`` and ``w10661`` have the same low 32 bits."""
    rows = [(0, "x w6164", "a"), (4, "y z", "a")] + [(i, "x w10661", "a") for i in (1, 2, 3)]
    check(spark, rows, ["x w6164"])


def test_known_words_in_another_order_cost_less_than_unknown_ones(spark):
    aim = spark.createDataFrame([("red green blue white",)] * 5, "text string")
    rows = [(1, "white blue green red", "a"), (2, "one two three four", "a")]
    got = {r.doc_id: r for r in lm.score(table(spark, rows), aim).collect()}
    assert got[1].target_loss < got[2].target_loss - 0.5


def test_memory_of_a_fragment(spark):
    """Twelve rows of 250,000 bigrams take less than half of what a small executor leaves a task."""
    rng = np.random.default_rng(1)
    texts, each, rows = 1_000, 250, 12
    n = texts * each
    firsts = np.arange(1_000, 11_000, dtype=np.uint64)
    first = [rng.integers(0, len(firsts), n).astype(np.uint16) for _ in range(rows)]
    seconds = [rng.integers(0, 100, n, np.uint64) for _ in range(rows)]
    frame = pd.DataFrame(
        {
            "side": np.arange(rows, dtype=np.int32) % 2,
            "batch": [bytes([i]) for i in range(rows)],
            "keys": b"",
            "own": b"",
            "width": 2,
            "texts": [np.arange(texts, dtype=np.uint16).tobytes()] * rows,
            "counts": [np.full(texts, each, np.uint16).tobytes()] * rows,
            "pairs": [(firsts[f] * np.uint64(1000) + s).tobytes() for f, s in zip(first, seconds, strict=True)],
            "firsts": [firsts.tobytes()] * rows,
            "first": [f.tobytes() for f in first],
        }
    )
    tracemalloc.start()
    try:
        found = lm._losses(frame, {}, (1, 1), 10)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    # 3 million bigrams, 50 bytes for each.
    assert len(found) == rows / 2 and peak < 150 << 20


def test_more_texts_or_bigrams_than_two_bytes_count(spark):
    """A batch of over 65,536 texts, and a text that has as many bigrams in each fragment."""
    rows = [(i, f"w{i % 50}", "a") for i in range(70_000)]
    check(spark, rows, ["w1 w2"])
    rng = random.Random(5)
    check(spark, [(1, " ".join(f"x{rng.randint(0, 900)}" for _ in range(700_000)), "a"), (2, "x1 x2", "a")], ["x1 x3"])
