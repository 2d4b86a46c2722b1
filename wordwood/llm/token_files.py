"""Token ids of documents as binary files: one array of ids and Elias-Fano coded boundaries.

The documents are range-sorted by key once, as text; each task tokenises its range in order and
cuts it into files. A file holds a header, the keys of its documents and the ends of their ids
(both ascending, so both Elias-Fano coded), and then the ids, in 16 bits where the vocabulary has
at most 65,536 ids, else in 32::

    magic (8 bytes), then as 64-bit numbers: documents, of these without a key, ids, bytes of an
    id, range, file within the range, smallest key | keys | ends | ids | one line feed

Files go through Spark's own writer, so they are committed as a whole and may lie in any store
that Spark reaches; the line feed is that writer's. Whoever has a file in memory finds any
document by two ``select`` calls, without a table of offsets: see :class:`TokenFile`.
"""

from __future__ import annotations

import itertools
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from wordwood.llm import elias_fano
from wordwood.llm.common import fragments_for, total_bytes, written

MAGIC = b"WWTOKEN1"
HEAD = "<8s6Qq"

# Text that one task tokenises; ids and documents after which a file is full.
BYTES_PER_TASK = 24 << 20
IDS_PER_FILE, DOCS_PER_FILE = 8 << 20, 1 << 17

# Text looked at in one go; words remembered, and the ids of these.
CHARS_AT_ONCE = 1 << 20
WORDS_KNOWN, IDS_KNOWN = 400_000, 6_000_000

# Punctuation that may end a word. The apostrophe is left out: it may belong to letters.
LETTERS = frozenset(string.ascii_letters)
ENDS = string.punctuation.replace("'", "")

# New words are tokenised in texts of so many, with a mark between them that is a token of its own, and
# so many in one call, as the tokenizer's results are large.
JOINED, LOT, MARK = 64, 16_384, "\x01"

# Boundaries that a reader selects in one go.
SELECT_AT_ONCE = 4096


class Known(dict):
    """Words with their numbers; a word that is looked up gets the next one, and is noted as new."""

    new: list[str]

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Token ids of texts; each different word of many texts is tokenised once.

    Holds for tokenizers in which no token crosses a space or a line feed and neither is
    a token itself, as where white space is dropped before words are cut.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.known = Known()
        self.lengths, self.starts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = "".join(filter(self.cuts, ENDS))
        self.lower, self.letters, self.mark = False, None, ""
        if self.knows_letters():
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = WhitespaceSplit()
            self.mark = self.tokenizer.pre_tokenizer.pre_tokenize_str(MARK)[0][0]

    def cuts(self, end: str) -> bool:
        """Whether letters and this punctuation after them are never in one token."""
        before = self.tokenizer.pre_tokenizer
        return before is not None and all(
            [t for t, _ in before.pre_tokenize_str(x + more)] == [x, more]
            for x in ("a", "ab", "Ab")
            for more in (end, end * 3, f"{end}.", f",{end}")
        )

    def knows_letters(self) -> bool:
        """Whether a word of ASCII letters is one piece for the model, but for its case."""
        before, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if before is None or any(a.isalpha() for a in self.added):
            return False
        small = string.ascii_lowercase
        words = [small, *(a + b for a in small for b in small)]
        words += [w.upper() for w in words] + [w.title() for w in words]
        shown = [normal.normalize_str(w) if normal else w for w in words]
        self.lower = shown == [w.lower() for w in words]
        return (self.lower or shown == words) and all(
            [t for t, _ in before.pre_tokenize_str(w)] == [w] for w in shown
        )

    def each(self, words: list[str], tokenizer: Tokenizer, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        end = tokenizer.encode(mark, add_special_tokens=False).ids
        if len(end) == 1 and not any(mark in w for w in words):
            parts = []
            for lot in itertools.batched(words, LOT):
                joined = [f" {mark} ".join(some) for some in itertools.batched(lot, JOINED)]
                found = tokenizer.encode_batch_fast(joined, add_special_tokens=False)
                ends = itertools.chain.from_iterable((*x.ids, end[0]) for x in found)
                parts.append(np.fromiter(ends, np.uint32))
            ids = np.concatenate([np.empty(0, np.uint32), *parts])
            marks = np.flatnonzero(ids == end[0])
            if len(marks) == len(words):
                return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        found = [x.ids for x in tokenizer.encode_batch(words, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        return ids, np.fromiter(map(len, found), np.int64, len(found))

    def learn(self) -> None:
        """Tokenise the new words.

        A word that ends in punctuation has the ids of what it is without and those of its end,
        if the tokenizer cuts it there; one with capitals, those of it without, if the tokenizer drops them. Words of
        letters alone need not be cut, so the model gets them as they are.
        """
        new, ended, capital, whole, letters = self.known.new, [], [], [], []
        for i, word in enumerate(new):
            bare = word.rstrip(self.cut)
            if len(bare) < len(word) and bare[-1:] in LETTERS and not any(a in word for a in self.added):
                ended.append((i, self.known[bare], self.known[word[len(bare) :]]))
            elif self.letters is None or not (word.isascii() and word.isalpha()):
                whole.append(i)
            elif self.lower and not word.islower():
                capital.append((i, self.known[word.lower()], self.known[""]))
            else:
                letters.append(i)
        known, lengths, starts = len(self.lengths), np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for which, tokenizer, mark in ((whole, self.tokenizer, MARK), (letters, self.letters, self.mark)):
            if which:
                ids, lengths[which] = self.each([new[i] for i in which], tokenizer, mark)
                starts[which] = len(self.ids) + np.cumsum(lengths[which]) - lengths[which]
                self.ids = np.concatenate([self.ids, ids])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, starts])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        # What others are made of comes first.
        for made in filter(None, (capital, ended)):
            at, *parts = np.array(made).T
            parts = np.stack(parts, axis=1)
            lengths = self.lengths[parts].sum(1)
            self.lengths[known + at] = lengths
            self.starts[known + at] = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, self.gathered(parts.reshape(-1))])

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        # A lot has far fewer ids than 32 bits can count.
        at = np.repeat((self.starts[numbers] - ends + lengths).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at]

    def forget(self) -> None:
        """Keep the words that were used most since the last time, half of the bound at most."""
        often = np.argsort(-self.uses, kind="stable")[: WORDS_KNOWN // 2]
        often = often[(self.uses[often] > 1) & (self.lengths[often] <= IDS_KNOWN // WORDS_KNOWN)]
        words = list(self.known)
        words = [words[i] for i in often]
        self.known = Known(zip(words, range(len(words)), strict=True))
        self.ids = self.gathered(often) if len(often) else self.ids[:0]
        self.lengths = self.lengths[often]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = np.zeros(len(words), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, looked at together."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        if len(self.known) > WORDS_KNOWN or len(self.ids) > IDS_KNOWN:
            self.forget()
        self.known.new = []
        words = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        which = numbers[coded.indices.to_numpy()]
        if self.known.new:
            self.learn()
        self.uses += np.bincount(which, minlength=len(self.uses)).astype(np.int32)
        stops = np.cumsum(self.lengths[which])
        return np.split(self.gathered(which), stops[ends - 1][:-1])


def pieces(texts: Iterator[tuple[int | None, str]]) -> Iterator[list[tuple[int | None, str, bool]]]:
    """Texts with their keys in lots of about ``CHARS_AT_ONCE`` characters.

    Longer texts are cut at spaces; each piece says whether it is the last one of its text.
    """
    lot, held = [], 0
    for key, text in texts:
        at = 0
        while len(text) - at > CHARS_AT_ONCE and (cut := text.find(" ", at + CHARS_AT_ONCE)) >= 0:
            yield [*lot, (key, text[at:cut], False)]
            lot, held, at = [], 0, cut + 1
        lot.append((key, text[at:], True))
        held += len(text) - at
        if held >= CHARS_AT_ONCE or len(lot) >= DOCS_PER_FILE:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def pack(keys: list[int | None], lengths: list[int], ids: np.ndarray, place: tuple[int, int]) -> bytes:
    """One file. ``keys`` ascend, nulls first; ``place`` is the range and the file in it."""
    nulls = sum(k is None for k in keys)
    least = keys[nulls] if nulls < len(keys) else 0
    known = np.array([k - least for k in keys[nulls:]], np.uint64)
    ends = np.cumsum(np.array(lengths, np.uint64))
    head = struct.pack(HEAD, MAGIC, len(keys), nulls, len(ids), ids.dtype.itemsize, *place, least)
    return b"".join([head, elias_fano.encode(known), elias_fano.encode(ends), ids.tobytes()])


class TokenFile:
    """A file in memory: ids and keys of its documents by their number in the file."""

    def __init__(self, data: bytes | memoryview):
        magic, self.n_docs, self.nulls, self.n_ids, width, part, file, self.least = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.place = part, file
        self.key_code = elias_fano.EliasFano(data, struct.calcsize(HEAD))
        self.end_code = elias_fano.EliasFano(data, self.key_code.end)
        self.all_ids = np.frombuffer(data, f"<u{width}", self.n_ids, self.end_code.end)

    def offsets(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of documents ``first`` to ``last - 1`` start and end."""
        ends = self.end_code.select(np.arange(max(first - 1, 0), last)).astype(np.int64)
        return (ends[:-1], ends[1:]) if first else (np.append(0, ends[:-1]), ends)

    def keys(self, first: int, last: int) -> list[int | None]:
        known = np.arange(max(first, self.nulls), last)
        found = self.key_code.select(known - self.nulls).tolist() if len(known) else []
        return [None] * (last - first - len(known)) + [k + self.least for k in found]

    def ids(self, doc: int) -> np.ndarray:
        (start,), (end,) = self.offsets(doc, doc + 1)
        return self.all_ids[start:end]


def _packed(batches: Iterator[pa.RecordBatch], vocabulary, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    encoder, part, file = Encoder(vocabulary.value), TaskContext.get().partitionId(), 0
    keys, lengths, parts, held, open_ids = [], [], [], 0, 0
    end = np.array([end_id], kind)

    def full() -> pa.RecordBatch:
        data = pack(keys, lengths, np.concatenate(parts), (part, file))
        return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

    rows = (
        (key.as_py(), text.as_py() or "")
        for batch in batches
        for key, text in zip(batch.column(0), batch.column(1), strict=True)
    )
    for lot in pieces(rows):
        for (key, _, last), ids in zip(lot, encoder.encode([t for _, t, _ in lot]), strict=True):
            parts.append(ids.astype(kind))
            open_ids += len(ids)
            if not last:
                continue
            parts.append(end)
            keys.append(key)
            lengths.append(open_ids + 1)
            held, open_ids = held + open_ids + 1, 0
            if held >= IDS_PER_FILE or len(keys) >= DOCS_PER_FILE:
                yield full()
                keys, lengths, parts, held, file = [], [], [], 0, file + 1
    if keys:
        yield full()


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the token ids of all documents, in ascending order of their keys, as files at ``path``.

    ``vocabulary`` is the path of a tokenizer file, which the driver reads and sends to the tasks;
    ``end_id`` is put after each document. Null and empty texts have only that id. Null keys come
    first. Rows with equal keys are documents of their own, in the order of a hash of their texts.
    An empty table gives no file with content. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    size = max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(content)
    order = ["key", "hash", "row"]
    rows = docs.select(
        F.col(key).cast("bigint").alias("key"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("hash"),
        # Equal rows, however many, may go to several tasks.
        F.monotonically_increasing_id().alias("row"),
    )
    tasks = fragments_for(spark, total_bytes(docs, text), BYTES_PER_TASK)
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("key", "text")
    files = rows.mapInArrow(lambda batches: _packed(batches, sent, end_id, kind), "data binary")
    # One row, one file. The cast keeps the bytes as they are.
    files.select(F.col("data").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1
    ).text(path)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            file = TokenFile(memoryview(content.as_buffer()))
            for first in range(0, file.n_docs, SELECT_AT_ONCE):
                last = min(first + SELECT_AT_ONCE, file.n_docs)
                starts, ends = file.offsets(first, last)
                sums = [
                    zlib.crc32(file.all_ids[s:e].astype("<u4").tobytes())
                    for s, e in zip(starts.tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array([file.place[0]] * len(sums), pa.int64()),
                        "file": pa.array([file.place[1]] * len(sums), pa.int64()),
                        "doc_id": pa.array(file.keys(first, last), pa.int64()),
                        "begins": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(ends - starts, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """What the files at ``path`` hold, one row per document.

    Returns ``doc_id, start, n_tokens, ids_crc32``: the ids of all documents before it, its own
    with the end, and the checksum of these as little-endian 32-bit numbers.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    found = files.mapInArrow(
        _unpacked, "range long, file long, doc_id long, begins long, n_tokens long, ids_crc32 long"
    )
    found = written(found, "token-rows")
    # One row per file of millions of ids, so its running sum is small.
    totals = found.groupBy("range", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("range", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return found.join(starts, ["range", "file"]).select(
        "doc_id", (F.col("before") + F.col("begins")).alias("start"), "n_tokens", "ids_crc32"
    )
