"""Counting words. One scan, one generator, one aggregation by word.

A word that makes up a third of all tokens costs no more than any other: each task sums its
own tokens before the shuffle, so at most one row per word and task travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.functions.text import WHITESPACE_CHARS, lines, raw_tokens

# Bytes of text that a task splits and sums at a time: they bound its memory.
BYTES_AT_ONCE = 8 << 20

# White space of one byte becomes a space in one step; texts with other white space go a longer way.
SPACED = bytes(32 if chr(c) in WHITESPACE_CHARS and c < 128 else c for c in range(256))
RARE_STARTS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def to_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """The lines of multi-line text, ``value string``, as a scan of a text file gives them."""
    return df.select(F.explode(lines(F.col(col))).alias("value"))


def tokenize(
    df: DataFrame, col: str = "text", mode: str = "whitespace", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per non-empty token, in column ``word``, next to the columns in ``keep``.

    In mode ``space`` the text must be one line per row (see :func:`to_lines`).
    """
    words = F.explode(raw_tokens(F.col(col), mode)).alias("word")
    return df.select(*keep, words).where(F.col("word") != "")


def token_total(
    df: DataFrame, col: str = "text", mode: str = "whitespace", by: tuple[str, ...] = ()
) -> DataFrame:
    """Number of tokens, overall or per group."""
    return tokenize(df, col, mode, by).groupBy(*by).agg(F.count("*").alias("tokens"))


def _spaced(raw: bytes, mode: str) -> bytes:
    """A text in which spaces alone stand between its words."""
    if not raw.isascii():
        raw = raw.decode("utf-8", "replace").encode()
    if mode == "space":
        return raw.decode().strip(WHITESPACE_CHARS).encode()
    if not raw.isascii() and any(start in raw for start in RARE_STARTS):
        return " ".join(raw.decode().split()).encode()
    return raw.translate(SPACED)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text, cut between words if it is long."""
    at = 0
    while len(text) - at > BYTES_AT_ONCE and (end := text.find(b" ", at + BYTES_AT_ONCE)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _summed(pieces: list[bytes]) -> pa.RecordBatch:
    """How often each word occurs in these pieces."""
    joined = pa.array([b" ".join(pieces)], pa.large_binary()).cast(pa.large_string())
    counts = pc.split_pattern(joined, " ").values.value_counts()
    word, n = counts.field("values").cast(pa.string()), counts.field("counts")
    found = pa.RecordBatch.from_arrays([word, n], ["word", "partial_count"])
    return found.filter(pc.not_equal(word, ""))


def _word_sums(batches: Iterator[pa.RecordBatch], mode: str) -> Iterator[pa.RecordBatch]:
    """The words of a task's texts, summed for many texts at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if raw is None:
                continue
            for piece in _pieces(_spaced(raw, mode)):
                held.append(piece)
                size += len(piece)
                if size > BYTES_AT_ONCE:
                    yield _summed(held)
                    held, size = [], 0
    if held:
        yield _summed(held)


def word_counts(df: DataFrame, col: str = "text", mode: str = "whitespace") -> DataFrame:
    """How often each word occurs: ``word, n``. Case and punctuation are kept.

    Each task sums its words as it splits the texts, so no row is made for a single token.
    """
    raw_tokens(F.col(col), mode)  # for its error
    texts = df.select(F.col(col).cast("string").cast("binary"))
    sums = texts.mapInArrow(lambda batches: _word_sums(batches, mode), "word string, partial_count long")
    return sums.groupBy("word").agg(F.sum("partial_count").alias("n"))


def distinct_words(
    df: DataFrame, col: str = "text", mode: str = "whitespace", by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact number of different words, overall or per group."""
    words = tokenize(df, col, mode, by)
    return words.groupBy(*by).agg(F.count_distinct("word").alias("distinct_words"))


def top_words(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent words; ties go to the alphabetically smaller word."""
    return counts.orderBy(F.desc("n"), F.asc("word")).limit(k)


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both counts of each word, null where a side lacks it.

    Each side has a word once and arrives partitioned by it, so the join adds no shuffle.
    """
    pairs = left.withColumnRenamed("n", "n_left").join(
        right.withColumnRenamed("n", "n_right"), "word", "full"
    )
    return pairs.select("word", "n_left", "n_right")


def counts_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words whose counts differ between two results of :func:`word_counts`."""
    n_left, n_right = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_left", "n_right"))
    pairs = _side_by_side(left, right)
    return pairs.select("word", n_left.alias("n_left"), n_right.alias("n_right")).where(
        "n_left <> n_right"
    )


def counts_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct words per side, whether these agree, and whether all counts do."""
    differs = ~F.col("n_left").eqNullSafe(F.col("n_right"))
    totals = _side_by_side(left, right).agg(
        F.count("n_left").alias("distinct_left"),
        F.count("n_right").alias("distinct_right"),
        F.count_if(differs).alias("different_words"),
    )
    return totals.select(
        "distinct_left",
        "distinct_right",
        "different_words",
        (F.col("distinct_left") == F.col("distinct_right")).alias("same_distinct"),
        (F.col("different_words") == 0).alias("identical"),
    )


def text_size_mb(df: DataFrame, col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Size in MB that the rows would have as lines of a UTF-8 text file."""
    size = F.sum(F.octet_length(F.col(col)) + 1) / F.lit(1048576.0)
    return df.groupBy(*by).agg(size.alias("size_mb"))
