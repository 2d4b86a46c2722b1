"""Quality of a text by a small convolutional network over its bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Every byte becomes a few numbers that
are learned, and one more: whether the four bytes from here on were seen just before. Learned
filters slide over each chunk; the largest value of each filter is kept. A text is described by
the largest and by the mean value of each filter over its chunks, and a logistic unit makes one
probability of that.

The network is trained in the driver, on a bounded sample of labelled rows: the bound is a
parameter, and the sample is the same in every run. Scoring runs inside tasks, on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK, OVERLAP = 512, 16
WIDTH, STRIDE = 8, 4
DIMS, FILTERS = 8, 32
PAD = 256
REPEAT_GRAM, REPEAT_BACK = 4, 24

# The bounds of the training sample: rows of each label, and bytes of a text.
SAMPLE_ROWS, SAMPLE_BYTES = 600, 32_768

# Pieces of a longer text, of characters of up to four bytes.
SAMPLE_PIECES = 8
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 10, 300, 48, 0.01, 1e-4

# Scored at a time; bounds the memory of a task whatever the length of a text.
CHUNKS_AT_ONCE = 256

HELD_OUT = 5
THRESHOLD = 0.3


def chunk_count(text: bytes) -> int:
    return max(1, -(-(len(text) - OVERLAP) // (CHUNK - OVERLAP)))


def chunked(text: bytes, first: int = 0, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and repeat marks of the chunks, padded: two arrays of ``chunks x CHUNK``.

    Of a long text ``most`` chunks from ``first`` on are made; only their bytes and a few beside them are looked at.
    """
    step = CHUNK - OVERLAP
    count = chunk_count(text) - first
    if most is not None:
        count = min(count, most)
    size = step * count + OVERLAP
    begin = step * first
    context = min(begin, REPEAT_BACK)
    raw = np.frombuffer(text, np.uint8)[begin - context : begin + size + REPEAT_GRAM - 1].astype(np.uint32)
    own = raw[context : context + size]
    data = np.full(size, PAD, np.int64)
    data[: len(own)] = own
    marks = np.zeros(size, np.float32)
    n = len(raw) - REPEAT_GRAM + 1
    if n > 0:
        gram = np.zeros(n, np.uint32)
        for i in range(REPEAT_GRAM):
            gram = gram << np.uint32(8) | raw[i : i + n]
        again = np.zeros(n, bool)
        for back in range(2, min(REPEAT_BACK, n - 1) + 1):
            again[back:] |= gram[back:] == gram[:-back]
        again = again[context : context + size]
        marks[: len(again)] = again
    starts = np.arange(count)[:, None] * step + np.arange(CHUNK)
    return data[starts], marks[starts]


@dataclass
class Network:
    """Weights of the network; ``constant`` stands for all of them where there is no contrast."""

    bytes_: np.ndarray = field(default_factory=lambda: np.zeros((PAD + 1, DIMS), np.float32))
    filters: np.ndarray = field(
        default_factory=lambda: np.zeros((WIDTH * (DIMS + 1), FILTERS), np.float32)
    )
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(2 * FILTERS, np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    constant: float | None = None

    def windows(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """What the filters see: ``chunks x places x (WIDTH * (DIMS + 1))``."""
        seen = np.empty((*data.shape, DIMS + 1), np.float32)
        seen[..., :DIMS] = self.bytes_[data]
        seen[..., DIMS] = marks
        places = (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = seen.strides
        return np.lib.stride_tricks.as_strided(
            seen, (len(data), places, WIDTH * (DIMS + 1)), (a, b * STRIDE, c)
        )

    def pooled(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each chunk."""
        window = self.windows(data, marks)
        flat = window.reshape(-1, window.shape[-1]) @ self.filters
        return np.maximum(flat.reshape(*window.shape[:2], FILTERS).max(1) + self.bias, 0)

    def features(self, text: bytes) -> np.ndarray:
        """The largest and the mean value of each filter over all chunks, some chunks at a time."""
        chunks = chunk_count(text)
        largest, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for first in range(0, chunks, CHUNKS_AT_ONCE):
            top = self.pooled(*chunked(text, first, CHUNKS_AT_ONCE))
            largest = np.maximum(largest, top.max(0))
            total += top.sum(0)
        return np.concatenate([largest, total / chunks])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """A probability for each text; the empty text and null are one text like any other."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        scores = np.empty(len(texts))
        for i, text in enumerate(texts):
            scores[i] = self.features((text or "").encode()) @ self.out + self.shift[0]
        return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def train(texts: Sequence[str], labels: Sequence[int], seed: int = 42) -> Network:
    """Fit a network by Adam on the logistic loss. Without both labels it is a constant."""
    y_all = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        return Network(constant=float(y_all.mean()) if len(y_all) else 0.5)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (PAD + 1, DIMS)).astype(np.float32),
        rng.normal(0, 0.15, (WIDTH * (DIMS + 1), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )
    weights = [net.bytes_, net.filters, net.bias, net.out, net.shift]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    parts = [chunked(t.encode()) for t in texts]
    step = 0
    # A small sample is gone through more often.
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(parts)))
    for epoch in range(epochs):
        order = rng.permutation(len(parts))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            step += 1
            for w, g, (m, v) in zip(
                weights, _gradients(net, [parts[i] for i in rows], y_all[rows]), moments, strict=True
            ):
                g = g + DECAY * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, parts: list, y: np.ndarray) -> list[np.ndarray]:
    data = np.concatenate([d for d, _ in parts])
    marks = np.concatenate([m for _, m in parts])
    sizes = np.array([len(d) for d, _ in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(parts)), sizes)
    values = np.empty((len(data), FILTERS), np.float32)
    places = np.empty((len(data), FILTERS), np.int64)
    for i in range(0, len(data), CHUNKS_AT_ONCE):
        window = net.windows(data[i : i + CHUNKS_AT_ONCE], marks[i : i + CHUNKS_AT_ONCE])
        made = (window.reshape(-1, window.shape[-1]) @ net.filters).reshape(*window.shape[:2], FILTERS)
        at = made.argmax(1)
        places[i : i + CHUNKS_AT_ONCE] = at
        values[i : i + CHUNKS_AT_ONCE] = np.take_along_axis(made, at[:, None], 1)[:, 0]
    top = np.maximum(values + net.bias, 0)
    largest = np.maximum.reduceat(top, starts)
    mean = np.add.reduceat(top, starts) / sizes[:, None]
    both = np.concatenate([largest, mean], 1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.shift[0], -30, 30)))
    d = ((p - y) / len(y)).astype(np.float32)
    d_both = d[:, None] * net.out
    # The largest chunk of each text gets that part; where two are equal they share it.
    is_top = top == largest[doc]
    share = np.add.reduceat(is_top.astype(np.float32), starts)[doc]
    d_top = d_both[doc, :FILTERS] * is_top / share + d_both[doc, FILTERS:] / sizes[doc][:, None]
    d_top = (d_top * (top > 0)).astype(np.float32)
    # Only the place of the largest value has a part in the gradient.
    chunk = np.arange(len(data))[:, None, None]
    at = places[:, :, None] * STRIDE + np.arange(WIDTH)
    codes = data[chunk, at]
    seen = np.concatenate([net.bytes_[codes], marks[chunk, at][..., None]], 3)
    d_filters = np.einsum("cf,cfk->kf", d_top, seen.reshape(*seen.shape[:2], -1), optimize=True)
    back = net.filters.T.reshape(FILTERS, WIDTH, DIMS + 1)[None, ..., :DIMS] * d_top[..., None, None]
    flat = codes.ravel()
    d_bytes = np.stack(
        [np.bincount(flat, back[..., k].ravel(), PAD + 1) for k in range(DIMS)], 1
    ).astype(np.float32)
    return [d_bytes, d_filters, d_top.sum(0), both.T @ d, d.sum(keepdims=True)]


def _remainder(key):
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Network:
    """Train on at most ``rows`` labelled documents of each label, none of them held out.

    The rows are those with the smallest digests of their ids among the labelled ones; null texts are left
    out. Of texts over ``sample_bytes`` the network learns from pieces that are spread evenly over the whole
    text and make up that size at most.
    """
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & (_remainder(F.col("id")) != 0)
    )
    order = F.md5(F.col("id").cast("string").cast("binary"))
    chosen = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(order, "id").limit(rows)
        chosen = some if chosen is None else chosen.unionAll(some)
    # At most twice ``rows`` short rows are broadcast, so no text is moved but theirs.
    long = F.octet_length("text") > sample_bytes
    each = sample_bytes // (4 * SAMPLE_PIECES)
    pieces = F.concat(
        *[
            F.substring(F.col("text"), (F.length("text") * i / SAMPLE_PIECES).cast("int") + 1, F.lit(each))
            for i in range(SAMPLE_PIECES)
        ]
    )
    read = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    read = read.withColumn("text", F.when(long, pieces).otherwise(F.col("text")))
    sample = read.join(F.broadcast(chosen), "id").select("id", "text", "label")
    found = sample.orderBy(order, "id", F.md5(F.col("text").cast("binary"))).limit(2 * rows)
    found = found.collect()
    return train([r["text"] for r in found], [r["label"] for r in found])


def _scored(net: Network):
    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.score(texts.tolist()))

    return scored


def classify(
    docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Score every whole text: ``doc_id, held_out, score, predicted``, one row per row.

    Null counts as the empty text, which has a score as well. Repeated rows and null ids are
    scored like any others; other columns are not read. No rows are moved.
    """

    rows = docs.select(
        F.col(key).alias("doc_id"),
        (_remainder(F.col(key)) == 0).alias("held_out"),
        _scored(net)(F.col(text)).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_low_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the network accepts, with all their columns."""
    return docs.where(_scored(net)(F.col(text)) >= THRESHOLD)
