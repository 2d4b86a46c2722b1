"""Cross-entropy difference: how much more a text is like a target corpus than like the background.

Two models of the same form are counted, one over the target, one over the background,
and smoothed over one vocabulary, that of both together. The loss of a word after another is the weighted mean of two: minus
the logarithm of its probability after that word, and of its probability alone. So a word that the target
knows, in an order that it does not, costs less than a word that it does not know. The mean of logarithms stands for a product of
both probabilities, not brought back to a sum of one; as it is a sum, each part is counted where
its counts are. A document's score is the mean over its words of the
target's loss less that of the background. Low scores are like the target.

Neither model fits into a task, so the words go to the counts, not the counts to the words.
Every bigram of every text is sent to the fragment of its first word, where all bigrams with that
word meet: there they are counted for both models, and the losses summed up per text at once.

Two things would put a share of all bigrams into one fragment, so they are counted before. A word
that is there more than ``often`` is spread over the fragments by the second word instead, and its
own count is sent along. A bigram that is there more than ``often`` is not sent at all: its two
counts are sent to the texts, and its losses summed there. ``often`` is 1 in ``HOT_SHARE`` of all
words, or a quarter of what a fragment stands for if that is less; so there are at most as many
frequent words, and bigrams, as ``HOT_SHARE`` or four times the fragments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.llm.common import fragments_for, lower_ascii, words, written

# Strength of the smoothing, in words, and the weight of the probability of a word alone.
MU = 2.0
ALONE = 0.5

HOT_SHARE = 1024

# Bigrams that one fragment stands for, fragments there are at least; bigrams sent on at a time
# and words remembered with their hashes, which bound a task's memory.
BIGRAMS_PER_FRAGMENT, LEAST_FRAGMENTS = 2_000_000, 8
BIGRAMS_AT_ONCE = 500_000
WORDS_KNOWN = 200_000

# The seed of the hash of words, the same inside and outside Python.
SEED = 42
# Stand-ins for the beginning and the end of a text; no word hashes to them but by chance. Every
# word is once the first of two, and the beginning is so as often as the end is a second: its count
# stands for that of the end.
START, END = np.uint64(1), np.uint64(2)


class WordHashes:
    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, with beginning and end; empty without words."""
        split = (text or "").encode().lower().split()
        if not split:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS_KNOWN:
            self.known.clear()
        for w in set(split).difference(self.known):
            self.known[w] = xxhash.xxh64_intdigest(w, SEED)
        out = np.empty(len(split) + 2, np.uint64)
        out[0], out[-1] = START, END
        out[1:-1] = np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split))
        return out


def _word_counts(background: DataFrame, target: DataFrame) -> DataFrame:
    """Every different word with its count on both sides: ``word, b, t``."""

    def of(texts: DataFrame, b: int, t: int) -> DataFrame:
        split = words(lower_ascii(F.col("text")))
        return texts.select(
            F.explode(F.transform(split, lambda w: F.xxhash64(w))).alias("word"),
            F.lit(b).alias("b"),
            F.lit(t).alias("t"),
        )

    both = of(background, 1, 0).unionAll(of(target, 0, 1))
    return both.groupBy("word").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[bytes, np.ndarray]]]]:
    """The side, and keys and word hashes of texts that have words, ``BIGRAMS_AT_ONCE`` together."""
    hashes = WordHashes()
    for side in batches:
        held, size = [], 0
        for text, key, which in zip(side["text"], side["key"], side["side"], strict=True):
            h = hashes.of(text)
            if len(h):
                held.append((key, h))
                size += len(h)
            if size > BIGRAMS_AT_ONCE:
                yield which, held
                held, size = [], 0
        if held:
            yield which, held


def _bigrams(held: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([h[:-1] for _, h in held])
    return first, np.concatenate([h[1:] for _, h in held])


MIX = np.uint64(0x9E3779B97F4A7C15)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of all bits of both words."""
    with np.errstate(over="ignore"):
        mixed = (first ^ (first >> np.uint64(29))) * MIX + second
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
    return mixed ^ (mixed >> np.uint64(29))


def _hot_pairs(batches: Iterator[pd.DataFrame], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """The bigrams of two frequent words, counted within the texts that are handled together."""
    ends = np.append(hot, END)
    for side, held in _held(batches):
        first, second = _bigrams(held)
        both = np.isin(first, hot)
        first, second = first[both], second[both]
        both = np.isin(second, ends)
        first = first[both]
        kinds, at, counts = np.unique(
            _pair(first, second[both]), return_index=True, return_counts=True
        )
        yield pd.DataFrame(
            {
                "pair": kinds.view(np.int64),
                "word": first[at].view(np.int64),
                "b": counts * (side == 0),
                "t": counts * (side == 1),
            }
        )


def _spread(
    batches: Iterator[pd.DataFrame], fragments: int, hot: np.ndarray, known: np.ndarray, loss: np.ndarray
) -> Iterator[pd.DataFrame]:
    """The bigrams of many texts together, one row per fragment that has some of them.

    ``known`` are the frequent bigrams, sorted, and ``loss`` their losses: they are summed up here
    and sent with the keys, to a fragment that the batch chooses.
    """
    for number, (side, held) in enumerate(_held(batches)):
        first, second = _bigrams(held)
        sizes = np.array([len(h) - 1 for _, h in held])
        text = np.repeat(np.arange(len(held)), sizes)
        pairs = _pair(first, second)
        own = np.zeros((3, len(held)))
        own[2] = sizes
        if len(known):
            where = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            here = known[where] == pairs
            for s in (0, 1):
                own[s] = np.bincount(text[here], loss[s][where[here]], len(held))
            first, second, text, pairs = (x[~here] for x in (first, second, text, pairs))
        with np.errstate(over="ignore"):
            by = np.where(np.isin(first, hot), first ^ second * MIX, first)
        at = ((by >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        pairs, text, first = pairs[order], text[order], first[order]
        bounds = np.searchsorted(at[order], np.arange(fragments + 1))
        keys = b"".join(key for key, _ in held)
        # Tasks may have equal texts: their batches still differ.
        name = f"{TaskContext.get().partitionId()} {number} ".encode()
        batch = xxhash.xxh128_digest(name + keys)
        home = int.from_bytes(batch[:4], "big") % fragments
        out = []
        for f in np.union1d(np.flatnonzero(np.diff(bounds)), home if side == 0 else []).astype(int):
            part = slice(bounds[f], bounds[f + 1])
            # The texts that have bigrams here, and how many.
            used, counts = np.unique(text[part], return_counts=True)
            words, word = np.unique(first[part], return_inverse=True)
            kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
            # Places and numbers of texts are mostly small, and there are many: they get few bytes.
            few = len(held) <= 1 << 16 and counts.max(initial=0) < 1 << 16
            short = np.uint16 if few else np.uint32
            mine = side == 0 and f == home
            out.append(
                (
                    f,
                    side,
                    batch,
                    keys if mine else b"",
                    own.tobytes() if mine else b"",
                    np.dtype(short).itemsize,
                    used.astype(short).tobytes() if side == 0 else b"",
                    counts.astype(short).tobytes() if side == 0 else b"",
                    pairs[part].tobytes(),
                    words.tobytes(),
                    word.astype(kind).tobytes(),
                )
            )
        yield pd.DataFrame(out, columns=SPREAD_COLUMNS)


SPREAD = (
    "fragment int, side int, batch binary, keys binary, own binary, width int, texts binary, "
    "counts binary, pairs binary, firsts binary, first binary"
)
SPREAD_COLUMNS = [c.split()[0] for c in SPREAD.split(", ")]


def _loss(joint, single, total: int, vocabulary: int):
    """The loss of a bigram, and of its first word alone, or of the end where that is the beginning."""
    after = -np.log((joint + MU / vocabulary) / (single + MU))
    alone = -np.log((single + MU / vocabulary) / (total + MU))
    return (1 - ALONE) * after + ALONE * alone


def _kinds(
    pairs: pd.Series, word: np.ndarray, is_target: np.ndarray
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Which kind of bigram each one is, and of each kind the first word, and the counts of both sides."""
    grams = np.concatenate([np.frombuffer(p, np.uint64) for p in pairs])
    order = np.argsort(grams).astype(np.int32)
    grams = grams[order]
    is_new = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=is_new[1:])
    del grams
    starts = np.flatnonzero(is_new)
    runs = np.diff(np.append(starts, len(order)))
    which = np.empty(len(order), np.int32)
    which[order] = np.repeat(np.arange(len(starts), dtype=np.int32), runs)
    target = np.add.reduceat(is_target[order], starts, dtype=np.int64)
    return which, word[order[starts]], (runs - target, target)


def _losses(rows: pd.DataFrame, hot: dict, totals: tuple[int, int], vocabulary: int) -> pd.DataFrame:
    """The losses of one fragment's bigrams under both models, summed per text that has some.

    Per bigram it holds two numbers of four bytes, and while it sorts two of eight more.
    """
    sizes = np.array([len(p) // 8 for p in rows["pairs"]])
    # The first words of all rows as one list, and the place of each bigram's in it.
    lists = [np.frombuffer(w, np.uint64) for w in rows["firsts"]]
    words, place = np.unique(np.concatenate(lists), return_inverse=True)
    place = np.split(place, np.cumsum([len(x) for x in lists])[:-1])
    word = np.empty(sizes.sum(), np.int32)
    end = 0
    for p, f, size in zip(place, rows["first"], sizes, strict=True):
        word[end : end + size] = p[np.frombuffer(f, np.uint16 if len(p) <= 1 << 16 else np.uint32)]
        end += size
    which, first, joints = _kinds(rows["pairs"], word, np.repeat(rows["side"].to_numpy() == 1, sizes))
    del word
    loss = []
    for s, joint in enumerate(joints):
        single = np.bincount(first, joint, len(words))
        for i, w in enumerate(words.tolist()) if hot else ():
            if w in hot:
                single[i] = hot[w][s]
        loss.append(_loss(joint, single[first], totals[s], vocabulary))
    out, end = [], 0
    names = ["batch", "keys", "own", "side", "width", "texts", "counts"]
    for batch, keys, own, of, width, texts, counts, size in zip(*[rows[n] for n in names], sizes, strict=True):
        mine = which[end : end + size]
        end += size
        if of == 0:
            counts = np.frombuffer(counts, f"u{width}").astype(np.int64)
            text = np.repeat(np.arange(len(counts)), counts)
            sums = [np.bincount(text, loss[s][mine], len(counts)) for s in (1, 0)]
            out.append((batch, keys, own, texts, np.stack(sums).tobytes()))
    return pd.DataFrame(out, columns=["batch", "keys", "own", "texts", "sums"])


def _per_text(rows: pd.DataFrame) -> pd.DataFrame:
    keys = b"".join(rows["keys"])
    # Target, background, bigrams: in ``loss`` the background is first.
    total = np.frombuffer(b"".join(rows["own"]), np.float64).reshape(3, -1)[[1, 0, 2]]
    n = total.shape[1]
    for texts, sums in zip(rows["texts"], rows["sums"], strict=True):
        sums = np.frombuffer(sums, np.float64).reshape(2, -1)
        if sums.size:
            # No text is twice in a row.
            total[:2, np.frombuffer(texts, f"u{len(texts) // sums.shape[1]}")] += sums
    return pd.DataFrame(
        {
            "key": [keys[16 * i : 16 * i + 16] for i in range(n)],
            "target": total[0],
            "background": total[1],
            "bigrams": total[2],
        }
    )


def score(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """The cross-entropy difference of every document, one row per row.

    ``docs`` is the background as well; ``target`` holds the texts to be like. Returns ``doc_id,
    n_words, target_loss, background_loss, score``: mean losses per word, the end of the text
    counted as a word, and their difference. Words are compared without the case of A-Z.

    Null and empty texts have no words: their losses and score are null. Repeated rows count as
    often as they are there, in the models too. Null ids are ids; other columns are not read.
    An empty target has a model without counts, so all its probabilities are equal.
    """
    read = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    read = read.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    aim = target.select(F.col(target_text).alias("text"))
    counted = written(_word_counts(read.select("text"), aim), "words")
    totals = counted.agg(
        F.count("*").alias("words"), F.sum("b").alias("b"), F.sum("t").alias("t")
    ).first()
    tokens = (totals["b"] or 0) + (totals["t"] or 0)
    # Each is more than that share of all, so there are few.
    often = min(tokens / HOT_SHARE, BIGRAMS_PER_FRAGMENT / 4)
    is_often = F.col("b") + F.col("t") > often
    frequent = counted.where(is_often).collect()
    texts = [
        x.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).count()
        for x in (read, aim)
    ]
    hashes = [int(START), *[r["word"] % (1 << 64) for r in frequent]]
    counts = {h: (r["b"], r["t"]) for h, r in zip(hashes[1:], frequent, strict=True)}
    counts[int(START)] = tuple(texts)
    # Words and ends of each side.
    ends = ((totals["b"] or 0) + texts[0], (totals["t"] or 0) + texts[1])
    hot = np.array(hashes, np.uint64)
    vocabulary = totals["words"] + 1
    fragments = max(LEAST_FRAGMENTS, fragments_for(docs.sparkSession, tokens, BIGRAMS_PER_FRAGMENT))

    sides = read.select("text", "key", F.lit(0).alias("side")).unionAll(
        aim.select("text", F.lit(b"").alias("key"), F.lit(1))
    )
    # A bigram is no more frequent than its words: only those of two such words can be.
    paired = sides.mapInPandas(lambda b: _hot_pairs(b, hot), "pair long, word long, b long, t long")
    paired = paired.groupBy("pair", "word").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    pairs = sorted(
        (r["pair"] % (1 << 64), (r["b"], r["t"]), counts[r["word"] % (1 << 64)])
        for r in paired.where(is_often).collect()
    )
    known = np.array([p for p, _, _ in pairs], np.uint64)
    loss = np.array(
        [[_loss(joint[s], single[s], ends[s], vocabulary) for _, joint, single in pairs] for s in (0, 1)]
    )
    spread = sides.mapInPandas(lambda b: _spread(b, fragments, hot, known, loss), SPREAD)
    summed = spread.groupBy("fragment").applyInPandas(
        lambda rows: _losses(rows, counts, ends, vocabulary),
        "batch binary, keys binary, own binary, texts binary, sums binary",
    )
    per_text = summed.groupBy("batch").applyInPandas(
        _per_text, "key binary, target double, background double, bigrams double"
    )
    # Equal texts have equal sums: their mean is that of their totals.
    per_text = per_text.groupBy("key").agg(
        F.sum("target").alias("target"),
        F.sum("background").alias("background"),
        F.sum("bigrams").alias("bigrams"),
        F.count("*").alias("texts"),
    )
    joined = read.select("doc_id", "key").join(per_text, "key", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.round(F.col("bigrams") / F.col("texts")).cast("bigint") - 1, F.lit(0)).alias("n_words"),
        (F.col("target") / F.col("bigrams")).alias("target_loss"),
        (F.col("background") / F.col("bigrams")).alias("background_loss"),
        ((F.col("target") - F.col("background")) / F.col("bigrams")).alias("score"),
    )
