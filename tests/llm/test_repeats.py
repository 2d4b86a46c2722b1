import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import SCHEMA, odd_rows, prose, table, vocabulary

from wordwood.llm import repeats
from wordwood.llm.grouping import suffix_order


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode), st.text("a", max_size=20).map(str.encode)))
def test_suffix_order(text):
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_order_of_a_longer_text():
    rng = random.Random(1)
    text = prose(rng, vocabulary(1, 30), 1500).encode()
    assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_hashes_do_not_show_the_place():
    data = np.frombuffer(b"xxabcdeyyyabcdez", np.uint8)
    h = repeats.Hashes(data).of(np.array([2, 10, 3]), np.array([7, 15, 8]))
    assert h[0] == h[1] != h[2]


def test_equal_strings_have_equal_anchors():
    rng = random.Random(2)
    words = vocabulary(2)
    same = prose(rng, words, 40).encode()
    found = []
    for _ in range(4):
        text = prose(rng, words, rng.randint(1, 60)).encode()
        _, grams, at, first, last = repeats.anchors(
            np.frombuffer(text + same, np.uint8), np.array([len(text) + len(same)])
        )
        inside = range(len(text), len(text) + len(same) - 99)
        found.append([
            next((g, a - s) for g, a, i, j in zip(grams, at, first, last, strict=True) if i <= s <= j)
            for s in inside
        ])
    assert found[0] == found[1] == found[2] == found[3]


def plain(rows):
    def order(row):
        return row[0] is None, row[0] or 0, hashlib.md5(row[1]).digest()

    seen, out = set(), {}
    for row in sorted({(i, (t or "").encode()) for i, t, *_ in rows}, key=order):
        raw = row[1]
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[row] = (len(raw), sum(gone), spans, kept)
    return Counter((i, *out[i, (t or "").encode()]) for i, t, *_ in rows)


def repeated_rows(seed):
    rng, words = random.Random(seed), vocabulary(seed, 300)
    passages = [prose(rng, words, 40) for _ in range(6)]
    big = prose(rng, words, 400)
    rows = []
    for i in range(150):
        kind = rng.random()
        if kind < 0.2:
            text = prose(rng, words, rng.randint(1, 80))
        elif kind < 0.5:
            parts = [prose(rng, words, rng.randint(0, 30)), rng.choice(passages)]
            text = "".join([*parts, prose(rng, words, rng.randint(0, 30)), rng.choice(passages)])
        elif kind < 0.7:
            w = big.split(" ")
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words) + "é"
            text = " ".join(w)
        elif kind < 0.8:
            text = "Orre " * rng.randint(1, 200)
        elif kind < 0.9:
            text = rows[rng.randrange(len(rows))][1] if rows else None
        else:
            # One byte more or less than a string that counts.
            text = rng.choice(passages)[: rng.choice([99, 100, 101])]
        rows.append((i if rng.random() > 0.05 else None, text, "a"))
    return rows + rows[:5] + odd_rows()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_strings(spark, seed):
    rows = repeated_rows(seed)
    got = repeats.remove_repeats(table(spark, rows)).collect()
    want = plain(rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got)
    assert sum(r.n_removed for r in got) > 10_000


@pytest.mark.parametrize("at_once", [1, 600, 2000])
def test_small_batches_and_groups_cut_finer(spark, monkeypatch, at_once):
    for name, value in (("BYTES_AT_ONCE", 3000), ("SORTED_AT_ONCE", at_once)):
        monkeypatch.setattr(repeats, name, value)
    rows = repeated_rows(3)
    got = repeats.remove_repeats(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain(rows)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = repeats.remove_repeats(df, keep_bytes=False).collect()
    want = Counter((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in plain(rows).elements())
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_rows_of_anchors_name_only_their_texts():
    """Else each lot sends the names of all its texts to every fragment, and these grow with the corpus."""
    rng, words = random.Random(5), vocabulary(5)
    texts = [prose(rng, words, 60).encode() for _ in range(40)]
    frame = pd.DataFrame({"raw": texts, "text_key": [hashlib.md5(t).digest() for t in texts]})
    whole = pd.concat(repeats._anchor_rows(iter([frame]), 1))
    rows = pd.concat(repeats._anchor_rows(iter([frame]), 5000))
    assert rows["fragment"].is_unique and len(rows) < 5000
    pairs = sum(len(c) // 4 for c in rows["counts"])
    assert sum(map(len, rows["keys"])) == 16 * pairs
    assert all((np.frombuffer(c, np.int32) > 0).all() for c in rows["counts"])
    assert sorted(np.frombuffer(b"".join(rows["grams"]), np.uint64)) == sorted(
        np.frombuffer(whole["grams"].iloc[0], np.uint64)
    )


def test_fragments_are_small():
    """Two tasks share a small executor; each holds the surroundings of a fragment's anchors many times over."""
    assert repeats.fragments_for(None, 512 << 20, repeats.BYTES_PER_FRAGMENT) >= 64
