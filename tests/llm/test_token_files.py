import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import SCHEMA, odd_rows, table
from tokenizers import Tokenizer

from wordwood.llm import elias_fano, queries
from wordwood.llm import token_files as tf
from wordwood.sources.scratch import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(VOCABULARY)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def summary(ids):
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(rows):
    """The rows (doc_id, n_tokens, crc) in order of their keys, nulls first."""
    found = [(i, *summary(plain(t))) for i, t in rows]
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def check(got, rows):
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted(
        (r.doc_id is not None, r.doc_id or 0) for r in got
    )
    got = sorted(
        ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
    )
    assert got == expected(rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3000), max_size=1300))
def test_elias_fano_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    data = b"12345678" + elias_fano.encode(values)
    code = elias_fano.EliasFano(data, 8)
    assert len(data) % 8 == 0 and code.end == len(data)
    assert code.select(np.arange(len(values))).tolist() == values.tolist()
    some = np.arange(len(values))[::-3]
    assert code.select(some).tolist() == values[some].tolist()


def test_boundaries_take_few_bits():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 800, 100_000))
    assert len(elias_fano.encode(ends)) * 8 < 100_000 * (2.3 + np.log2(400))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aΣσé̈'st \n\t\x01\x1c 　<|endoftxs>1", max_size=40), min_size=1))
def test_encoder_is_the_tokenizer(texts):
    encoder = tf.Encoder(open(VOCABULARY, encoding="utf-8").read())
    for lot in (texts, texts[::-1]):
        assert [x.tolist() for x in encoder.encode(lot)] == [plain(t)[:-1] for t in lot]


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(tf, "WORDS_KNOWN", 50)
    encoder = tf.Encoder(open(VOCABULARY, encoding="utf-8").read())
    for k in range(40):
        lot = [f"the word w{k * 20 + i} and x{k} <|endoftext|>" for i in range(20)]
        assert [x.tolist() for x in encoder.encode(lot)] == [plain(t)[:-1] for t in lot]
        assert len(encoder.known) < 150


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        # Several files for each task, texts cut inside, boundaries selected bit by bit.
        for name, value in (("IDS_PER_FILE", 60), ("CHARS_AT_ONCE", 500), ("SELECT_AT_ONCE", 2), ("BYTES_PER_TASK", 40_000)):
            monkeypatch.setattr(tf, name, value)
    rows = [(i, t) for i, t, _ in odd_rows()] + [(-7, "minus"), (2**62, "far"), (9, "<|endoftext|> x")]
    rows += [(11, "equal rows")] * 40
    path = scratch_path(spark, "tokens")
    tf.write_token_files(table(spark, [(i, t, "a") for i, t in rows]), path, VOCABULARY, 1)
    check(tf.read_token_files(spark, path).collect(), rows)


def test_ids_of_one_document(spark):
    rows = [(i, f"text number {i} " * (i % 5), "a") for i in range(300)]
    path = scratch_path(spark, "tokens")
    tf.write_token_files(table(spark, rows), path, VOCABULARY, 1)
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    found = {}
    for f in files:
        file = tf.TokenFile(bytes(f.content))
        for k, key in enumerate(file.keys(0, file.n_docs)):
            found[key] = file.ids(k).tolist()
        assert file.all_ids.dtype.itemsize == 2
    assert found == {i: plain(t) for i, t, _ in rows}


def test_wide_ids(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(table(spark, [(1, "a b", "a")]), path, VOCABULARY, 70_000)
    (f,) = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert tf.TokenFile(bytes(f.content)).ids(0).tolist() == plain("a b")[:-1] + [70_000]


def test_empty_table(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(spark.createDataFrame([], SCHEMA), path, VOCABULARY, 1)
    assert tf.read_token_files(spark, path).collect() == []


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op11_token_files(spark, sf_dir).collect(), [tuple(r) for r in rows])
