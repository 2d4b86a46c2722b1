import random
import zlib

import numpy as np
import pytest
from llm.helpers import SCHEMA, odd_rows, prose, table, vocabulary

from wordwood.llm import classifier
from wordwood.llm.classifier import CHUNK, OVERLAP, chunked


@pytest.mark.parametrize("n", [0, 1, 3, 15, 16, 17, 511, 512, 513, 1008, 1009, 5000])
def test_chunks_cover_the_text(n):
    text = bytes(random.Random(n).choices(range(97, 123), k=n))
    data, marks = chunked(text)
    assert data.shape == marks.shape and data.shape[1] == CHUNK
    back = [*data[0], *(x for row in data[1:] for x in row[OVERLAP:])]
    assert bytes(x for x in back if x < 256) == text
    if len(data) > 1:
        assert (data[1:, :OVERLAP] == data[:-1, -OVERLAP:]).all()


def test_marks_show_repeats():
    assert chunked(b"Orre Orre Orre")[1][0, :14].tolist() == [0] * 5 + [1] * 6 + [0] * 3
    assert chunked(b"abcdefghijklmnop")[1].sum() == 0


def plain_score(net, text):
    """The network written out, byte by byte."""
    top = []
    for data, marks in zip(*chunked(text.encode()), strict=True):
        seen = np.concatenate([net.bytes_[data], marks[:, None]], 1)
        places = range(0, CHUNK - classifier.WIDTH + 1, classifier.STRIDE)
        values = [seen[p : p + classifier.WIDTH].ravel() @ net.filters + net.bias for p in places]
        top.append(np.maximum(np.max(values, 0), 0))
    both = np.concatenate([np.max(top, 0), np.mean(top, 0)])
    return 1 / (1 + np.exp(-(both @ net.out + net.shift[0])))


def corpus(seed, n):
    rng, words = random.Random(seed), vocabulary(9)
    texts, labels = [], []
    for i in range(n):
        text = prose(rng, words, rng.randint(20, 300))
        junk = i % 4 == 0
        if junk:
            text = text.upper() if i % 8 else text.replace(" ", "$$$ ")
        texts.append(text)
        labels.append(int(not junk))
    return texts, labels


def test_gradients():
    """Each derivative is the slope of the loss."""
    texts, labels = corpus(2, 6)
    net = classifier.train(texts[:4], labels[:4])
    y = np.array(labels, np.float32)
    parts = [chunked(t.encode()) for t in texts]

    def loss():
        p = np.clip(net.score(texts), 1e-9, 1 - 1e-9)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip([net.bytes_, net.filters, net.bias, net.out, net.shift], classifier._gradients(net, parts, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = w[at], 1e-3
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-4)


def test_learning_and_scoring():
    net = classifier.train(*corpus(1, 200))
    texts, labels = corpus(3, 80)
    scores = net.score(texts)
    assert np.mean((scores >= 0.5) == np.array(labels)) >= 0.95
    for text in [texts[0], texts[1], "", "x" * 1000]:
        assert net.score([text])[0] == pytest.approx(plain_score(net, text), abs=1e-4)
    assert len(set(net.score([None, ""]))) == 1
    assert (classifier.train(*corpus(1, 200)).score(texts) == scores).all()


def test_one_label_or_none():
    assert classifier.train([], []).score(["a", None]).tolist() == [0.5, 0.5]
    assert classifier.train(["a", "b"], [1, 1]).score(["x"]).tolist() == [1.0]


def test_classify_odd_rows(spark):
    net = classifier.train(*corpus(1, 40))
    rows = odd_rows()
    got = classifier.classify(table(spark, rows), net).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert classifier.classify(spark.createDataFrame([], SCHEMA), net).collect() == []
    df = table(spark, rows)
    assert classifier.without_low_quality(df, net).columns == df.columns


def test_fit_uses_no_held_out_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, labels: seen.append((texts, labels)))
    docs = table(spark, [(i, f"text {i}", "a") for i in range(200)] * 2 + odd_rows())
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (3, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    classifier.fit(docs, labels, rows=30)
    texts, given = seen[0]
    ids = [int(t.split()[1]) for t in texts if t.startswith("text ")]
    assert 0 < len(texts) <= 60 and set(given) == {0, 1}
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    net = classifier.fit(docs, labels)
    got = classifier.classify(docs, net).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97
    assert all(r.predicted for r in got if r.quality)


def test_a_long_text_is_scored_in_ranges(monkeypatch):
    net = classifier.train(*corpus(1, 40))
    text = prose(random.Random(7), vocabulary(7), 4_000)
    whole = chunked(text.encode())
    for first in (0, 1, 5, len(whole[0]) - 1):
        part = chunked(text.encode(), first, 3)
        assert (part[0] == whole[0][first : first + 3]).all() and (part[1] == whole[1][first : first + 3]).all()
    monkeypatch.setattr(classifier, "CHUNKS_AT_ONCE", 4)
    assert net.score([text])[0] == pytest.approx(plain_score(net, text), abs=1e-4)


def test_long_labelled_texts_are_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda texts, labels: seen.append((texts, labels)))
    text = "".join(f"{i:07d} " for i in range(20_000))
    docs = table(spark, [(i, text, "a") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    classifier.fit(docs, labels, sample_bytes=8_000)
    texts, given = seen[0]
    assert set(given) == {0, 1} and all(1_000 < len(t) <= 8_000 for t in texts)
    # Pieces from the beginning to the end.
    assert text[:50] in texts[0] and "0017500" in texts[0]
