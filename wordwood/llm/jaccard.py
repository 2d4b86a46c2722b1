"""Near duplicates by an exact Jaccard join of n-gram sets, partitioned vertically.

The order of all n-grams (by hash) is cut into fragments. Texts are read in lots; a lot sends to
each fragment the parts of its sets that fall there, and only what is there. Inside a fragment the n-grams that only one set has are
dropped, as they can be in no overlap, and what is left goes back to its lot. Summed over the
fragments, its count bounds every overlap of a set from above, so a set that shares
less than the threshold with all others together is in no pair. Of the rest, the overlap of a
pair is counted part by part and summed.

Which pairs are counted: first each set against hubs for its MinHash values, which joins most
copies of a text to each other without listing their pairs. Then all pairs from
different components that share one of their first few prefix n-grams, and then, exactly, one of all: with the rarest n-grams first, two
sets that are similar enough have one of their prefixes in common. A sketch of each set drops
pairs that cannot be similar before their n-grams are looked at; it drops no other.

Equal sets count once. Which row stands for a set is found in a first pass over the texts; the second
pass, which sends the n-grams, must see the rows of each partition in the same order, as any scan of files
does. A checksum of each lot tells if it does not, and is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordwood.functions.hashing import fresh
from wordwood.llm.common import fragments_for, written
from wordwood.llm.components import components
from wordwood.sources.scratch import drop_path, scratch_path

# Words of an n-gram, least similarity in percent.
WIDTH = 5
LEAST_PCT = 80

# N-grams that one fragment stands for: a task holds some 50 bytes for each, two tasks share a small
# executor with a JVM that takes what it may.
NGRAMS_PER_FRAGMENT = 1_000_000

# Parts in which overlaps are counted, MinHash values that choose hubs, and n-grams of a prefix
# by which sets meet before they meet by all of it.
PARTS = 8
HUBS = 6
FIRST = 3

# Bits of the sketch that bounds the difference of two sets.
BITS = 1024
BIT_WORDS = [f"bits{i}" for i in range(BITS // 64)]

# N-grams and texts of a lot, and words remembered with their hashes: all bound a task's memory.
NGRAMS_AT_ONCE, TEXTS_AT_ONCE = 500_000, 4_000
WORDS_KNOWN = 100_000

MIX = np.uint64(0x9E3779B97F4A7C15)


class Sets:
    """The n-gram sets of texts, as sorted arrays of 64-bit hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of all runs of ``WIDTH`` words; of all words where there are fewer."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > WORDS_KNOWN:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(WIDTH, len(words))
        with np.errstate(over="ignore"):
            grams = hashes[: len(hashes) - width + 1] + np.uint64(width)
            for i in range(1, width):
                grams = (grams ^ (grams >> np.uint64(29))) * MIX
                grams += hashes[i : len(hashes) - width + 1 + i]
            grams = (grams ^ (grams >> np.uint64(32))) * MIX
            grams ^= grams >> np.uint64(29)
        return np.unique(grams)


def _lots(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, list[np.ndarray]]]:
    """Rows with the sets of their ``text``, many together, and the number of each lot.

    Lots depend on the rows of the partition and their order, not on how these come in.
    """
    sets, number = Sets(), TaskContext.get().partitionId() << 24
    held, grams, size = [], [], 0
    for frame in batches:
        start = 0
        for i, text in enumerate(frame["text"], 1):
            grams.append(sets.of(text))
            size += len(grams[-1])
            if size > NGRAMS_AT_ONCE or len(grams) >= TEXTS_AT_ONCE:
                yield number, pd.concat([*held, frame.iloc[start:i]]), grams
                held, grams, size, start, number = [], [], 0, i, number + 1
        held.append(frame.iloc[start:])
    if grams:
        yield number, pd.concat(held), grams


def _node(grams: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(grams.tobytes()) if len(grams) else b""


def _check(nodes: list[bytes]) -> int:
    """The checksum of a lot."""
    return int.from_bytes(xxhash.xxh64_digest(b"/".join(nodes)), "big", signed=True)


NAMED = "key string, text_md5 string, n_shingles long, node binary, lot long, idx int, chk long"


def _named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The name and size of the set of each text, and where it is among the lots."""
    for lot, rows, grams in _lots(batches):
        nodes = [_node(g) for g in grams]
        yield pd.DataFrame(
            {
                "key": rows["key"].to_numpy(object),
                "text_md5": rows["text_md5"].to_numpy(object),
                "n_shingles": [len(g) for g in grams],
                "node": [n or None for n in nodes],
                "lot": lot,
                "idx": np.arange(len(grams), dtype=np.int32),
                "chk": _check(nodes),
            }
        )


CUT = "fragment int, lot long, chk long, texts binary, counts binary, grams binary"


def _cut(batches: Iterator[pd.DataFrame], fragments: int) -> Iterator[pd.DataFrame]:
    """The parts of the sets of a lot, one row for each fragment that has some of it."""
    for lot, _, sets in _lots(batches):
        check = _check([_node(g) for g in sets])
        grams = np.concatenate(sets)
        text = np.repeat(np.arange(len(sets), dtype=np.int32), [len(g) for g in sets])
        # The leading bits of a hash, scaled: fragments are ranges of the order of hashes.
        at = ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        grams, text = grams[order], text[order]
        bounds = np.searchsorted(at[order], np.arange(fragments + 1))
        out = []
        for f in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[f], bounds[f + 1])
            texts, counts = np.unique(text[part], return_counts=True)
            out.append(
                (f, lot, check, texts.tobytes(), counts.astype(np.int32).tobytes(), grams[part].tobytes())
            )
        yield pd.DataFrame(out, columns=["fragment", "lot", "chk", "texts", "counts", "grams"])


def _owners(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one lot, the texts that stand for their sets, as bits."""
    bits = np.zeros(rows["idx"].max() + 1, bool)
    bits[rows["idx"]] = True
    return pd.DataFrame(
        {"lot": rows["lot"].iloc[:1], "chk": rows["chk"].iloc[:1], "owners": [np.packbits(bits).tobytes()]}
    )


SHARED = "lot long, texts binary, counts binary, grams binary, sets binary"


def _shared(rows: pd.DataFrame, owners: pd.DataFrame) -> pd.DataFrame:
    """Of each set that a fragment holds a part of, the n-grams that another set has as well.

    With each n-gram goes the number of sets that have it: all of them are in this fragment.
    """
    bits = {lot: (chk, own) for lot, chk, own in zip(owners["lot"], owners["chk"], owners["owners"], strict=True)}
    lots, parts = [], []
    for lot, chk, texts, counts, grams in zip(
        rows["lot"], rows["chk"], rows["texts"], rows["counts"], rows["grams"], strict=True
    ):
        if lot not in bits:
            continue
        if bits[lot][0] != chk:
            raise RuntimeError("the rows came in another order than before: write the table first")
        texts, counts = np.frombuffer(texts, np.int32), np.frombuffer(counts, np.int32)
        own = np.unpackbits(np.frombuffer(bits[lot][1], np.uint8))
        own = np.pad(own, (0, max(0, texts[-1] + 1 - len(own))))[texts].astype(bool)
        if own.any():
            lots.append((lot, texts[own], counts[own]))
            parts.append(np.frombuffer(grams, np.uint64)[np.repeat(own, counts)])
    out = []
    if parts:
        grams = np.concatenate(parts)
        ends = np.cumsum([len(p) for p in parts])
        del parts, rows
        order = np.argsort(grams).astype(np.int32)
        in_order = grams[order]
        starts = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
        del in_order
        runs = np.diff(np.append(starts, len(grams))).astype(np.int32)
        sets = np.empty(len(grams), np.int32)
        sets[order] = np.repeat(runs, runs)
        del order, starts, runs
        for (lot, texts, counts), end in zip(lots, ends, strict=True):
            mine = slice(end - counts.sum(), end)
            shared = sets[mine] > 1
            if shared.any():
                text = np.repeat(texts, counts)[shared]
                texts, counts = np.unique(text, return_counts=True)
                out.append(
                    (
                        lot,
                        texts.astype(np.int32).tobytes(),
                        counts.astype(np.int32).tobytes(),
                        grams[mine][shared].tobytes(),
                        sets[mine][shared].tobytes(),
                    )
                )
    return pd.DataFrame(out, columns=["lot", "texts", "counts", "grams", "sets"])


PART_NAMES = [f"part{p}" for p in range(PARTS)]
HASH_NAMES = [f"hash{k}" for k in range(HUBS)]
PROFILE = ", ".join(
    ["node binary", "size long", "alone long", "weight double", "prefix array<long>"]
    + [f"{name} long" for name in (*BIT_WORDS, *HASH_NAMES)]
    + [f"{name} array<long>" for name in PART_NAMES]
)


def _joined(names: str) -> list[str]:
    return [c.split()[0] for c in names.split(", ")]


def _profiles(rows: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """What is compared of the sets of one lot that may have a pair, one row per set.

    N-grams are in the order of rarity, then
    hash. ``prefix`` are those by which the set can be found, ``alone``
    counts the n-grams that no other set has: the rarest of all, they are not there and are
    only counted off. ``weight`` is the mean chance that a set with an n-gram of this one is
    another: of copies of a text the one that has changed least has the highest. Each of ``BITS``
    bits says whether the number of n-grams that fall there is odd.
    """
    out = []
    if len(rows) and len(members):
        names = dict(zip(members["idx"], zip(members["node"], members["n_shingles"], strict=True), strict=True))
        text = np.concatenate(
            [
                np.repeat(np.frombuffer(t, np.int32), np.frombuffer(c, np.int32))
                for t, c in zip(rows["texts"], rows["counts"], strict=True)
            ]
        )
        grams = np.concatenate([np.frombuffer(g, np.uint64) for g in rows["grams"]])
        sets = np.concatenate([np.frombuffer(s, np.int32) for s in rows["sets"]])
        order = np.lexsort((grams, text))
        text, grams, sets = text[order], grams[order], sets[order]
        used, starts = np.unique(text, return_index=True)
        for idx, start, end in zip(used.tolist(), starts, np.append(starts[1:], len(text)), strict=True):
            node, size = names[idx]
            if (end - start) * 100 >= size * LEAST_PCT:
                out.append((node, int(size), *_profile(grams[start:end], sets[start:end], int(size))))
    return pd.DataFrame(out, columns=_joined(PROFILE))


def _profile(grams: np.ndarray, sets: np.ndarray, size: int) -> tuple:
    alone = size - len(grams)
    first = max(0, size - -(-size * LEAST_PCT // 100) + 1 - alone)
    # The n-grams are sorted, so equally rare ones stay in the order of their hashes.
    prefix = grams[np.argsort(sets, kind="stable")[:first]].view(np.int64)
    odd = np.bincount((grams & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    seeds = np.arange(1, HUBS + 1, dtype=np.uint64)[:, None]
    with np.errstate(over="ignore"):
        mixed = (grams ^ (seeds * MIX)) * MIX
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX
        least = (mixed ^ (mixed >> np.uint64(29))).min(1).view(np.int64)
    cuts = np.searchsorted(grams >> np.uint64(32), np.arange(1, PARTS, dtype=np.uint64) * np.uint64(2**32 // PARTS))
    weight = float((1 - 1 / sets).sum() / size)
    return (alone, weight, prefix, *bits.tolist(), *least.tolist(), *np.split(grams.view(np.int64), cuts))


def _may_be_similar() -> Column:
    """Whether two sets, x and y, do not differ too much by sizes, lone n-grams and bits.

    Each odd bit of one set that is even in the other stands for an n-gram that only one has, so
    this bounds the difference from below and loses no pair.
    """
    lone = F.col("alone_x") + F.col("alone_y")
    differ = lone
    for word in BIT_WORDS:
        differ = differ + F.bit_count(F.col(f"{word}_x").bitwiseXOR(F.col(f"{word}_y")))
    most = (F.col("size_x") + F.col("size_y")) * (100 - LEAST_PCT)
    return (
        _near_in_size(F.col("size_x"), F.col("size_y"))
        & (lone * (100 + LEAST_PCT) <= most)
        & (differ * (100 + LEAST_PCT) <= most)
    )


def _possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that may be similar."""

    def of(name: str, tag: str) -> DataFrame:
        columns = ("size", "alone", *BIT_WORDS)
        return profiles.select(
            F.col("node").alias(name), *[F.col(c).alias(f"{c}_{tag}") for c in columns]
        )

    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    return both.where(_may_be_similar()).select("a", "b")


def _verified(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar enough. Overlaps are counted part by part and summed."""

    def of(name: str, tag: str) -> DataFrame:
        parts = [F.col(p).alias(f"{p}_{tag}") for p in PART_NAMES]
        return profiles.select(F.col("node").alias(name), F.col("size").alias(f"size_{tag}"), *parts)

    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
    partial = [F.size(F.array_intersect(f"{p}_x", f"{p}_y")).cast("bigint") for p in PART_NAMES]
    counted = both.select("a", "b", "size_x", "size_y", sum(partial[1:], partial[0]).alias("common"))
    union = F.col("size_x") + F.col("size_y") - F.col("common")
    return counted.where(F.col("common") * 100 >= union * LEAST_PCT).select("a", "b")


def _near_in_size(m: Column, n: Column) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * LEAST_PCT


def _min_hashes(profiles: DataFrame) -> DataFrame:
    """The MinHash values of each set: ``node, weight, k, value``."""
    values = F.posexplode(F.array(*HASH_NAMES)).alias("k", "value")
    return profiles.select("node", "weight", values)


def _hub_pairs(values: DataFrame) -> DataFrame:
    """Each set with the hub of every MinHash value that it has: the set of most weight."""
    hubs = values.groupBy("k", "value").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    pairs = values.join(hubs, ["k", "value"]).where(F.col("node") != F.col("hub"))
    return pairs.select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).distinct()


def _postings(profiles: DataFrame, labels: DataFrame, first: int | None = None) -> DataFrame:
    """The prefix n-grams that several components have: ``gram, label, main, node``.

    With ``first``, only the first n-grams of each prefix. ``main`` is the component that has most
    sets at the n-gram.
    """
    prefix = F.slice("prefix", 1, first) if first else F.col("prefix")
    posted = profiles.select("node", F.explode(prefix).alias("gram")).join(labels, "node")
    counts = posted.groupBy("gram", "label").agg(F.count("*").alias("sets"))
    mains = counts.groupBy("gram").agg(
        F.max(F.struct("sets", "label"))["label"].alias("main"), F.count("*").alias("labels")
    )
    mains = mains.where("labels > 1").select("gram", "main")
    return posted.join(mains, "gram").select("gram", "label", "main", "node")


def _cross_pairs(posted: DataFrame, profiles: DataFrame, one_each: bool) -> DataFrame:
    """Possible pairs of sets from different components that share an n-gram of their prefixes.

    ``posted`` are the n-grams by which they meet. Sets of the main component do not meet each
    other there: they only meet the rest, and the rest meets itself. What cannot be similar by size
    and sketch is dropped as it meets. With ``one_each`` only the set of most weight stands for its component.
    """
    known = profiles.select("node", "weight", "size", "alone", *BIT_WORDS)
    posted = posted.join(known, "node")
    if one_each:
        one = F.max(F.struct("weight", "node", "size", "alone", *BIT_WORDS)).alias("one")
        posted = posted.groupBy("gram", "label", "main").agg(one).select(
            "gram", "label", "main", "one.*"
        )

    def side(rows: DataFrame, tag: str) -> DataFrame:
        columns = ("label", "node", "size", "alone", *BIT_WORDS)
        return rows.select("gram", *[F.col(c).alias(f"{c}_{tag}") for c in columns])

    rest = side(posted.where("label <> main"), "x")
    with_main = rest.join(side(posted.where("label = main"), "y"), ["gram"])
    among = rest.join(side(posted.where("label <> main"), "y"), ["gram"])
    met = with_main.where(_may_be_similar()).unionAll(
        among.where((F.col("label_x") < F.col("label_y")) & _may_be_similar())
    )
    return met.select(
        F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")
    ).distinct()


def _merged(labels: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """The labels once the components that the links connect are one; as they are if no link does."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    edges = links.join(a, "a").join(b, "b").where("label_a <> label_b")
    edges = edges.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    edges = written(edges, "links", folder)
    if edges.isEmpty():
        return labels
    touched = edges.select("a").unionAll(edges.select("b")).distinct().toDF("node")
    merged = components(touched, edges, folder).toDF("old", "new")
    joined = labels.join(merged, labels["label"] == merged["old"], "left")
    return written(joined.select("node", F.coalesce("new", "label").alias("label")), "labels", folder)


def linked_sets(texts: DataFrame, sets: DataFrame, ngrams: int) -> DataFrame:
    """The component of each set that may have a link: ``node, label``.

    ``texts`` are the rows of the first pass. ``sets`` has every different set once, ``node, n_shingles, lot, idx, chk``: the text that stands
    for it. ``ngrams`` is the number of n-grams of all texts. What the search writes on its way is
    deleted once its result is written.
    """
    spark = texts.sparkSession
    folder = scratch_path(spark, "linked_sets")
    fragments = fragments_for(spark, ngrams, NGRAMS_PER_FRAGMENT)
    cut = texts.mapInPandas(lambda batches: _cut(batches, fragments), CUT)
    owners = sets.groupBy("lot").applyInPandas(_owners, "lot long, chk long, owners binary")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment")
    owners = owners.select("*", everywhere)
    shared = cut.groupBy("fragment").cogroup(owners.groupBy("fragment")).applyInPandas(_shared, SHARED)
    members = sets.select("lot", "idx", "node", "n_shingles")
    profiles = shared.groupBy("lot").cogroup(members.groupBy("lot")).applyInPandas(_profiles, PROFILE)
    profiles = written(profiles, "profiles", folder)
    labels = profiles.select("node", F.col("node").alias("label"))

    def linked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs", folder)
        return labels if pairs.isEmpty() else _merged(labels, _verified(pairs, profiles), folder)

    labels = linked(_possible(_hub_pairs(_min_hashes(profiles)), profiles), labels)
    for first, one_each in ((FIRST, True), (None, True), (None, False)):
        # A table between the steps: one plan of both is large, and the driver holds it.
        posted = written(_postings(profiles, labels, first), "posted", folder)
        if not posted.isEmpty():
            labels = linked(_cross_pairs(posted, profiles, one_each), labels)
    labels = written(labels, "labels")
    drop_path(spark, folder)
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The group of near duplicates of every document, one row per row.

    Returns ``doc_id, text_md5, n_shingles, component_id, group``: the size of the document's set
    of n-grams, the smallest id that it reaches by links, and a name of the group that is there
    even where ids are null. Two documents link when their sets
    have at least ``LEAST_PCT`` % of their union in common; equal sets are one set from the
    start, however many documents have them. Words are compared without the case of A-Z.

    Null and empty texts, and texts of white space, have no n-grams, no links and their own id.
    Null ids link like others but are never the smallest; a group of null ids only has a null
    ``component_id``. Repeated rows are in one group. Other columns are not read.
    """
    kind = docs.schema[key].dataType
    # Both passes read the same columns: with others Spark might deal the rows out otherwise.
    texts = docs.select(
        F.col(key).cast("string").alias("key"),
        F.md5(F.col(text).cast("binary")).alias("text_md5"),
        F.col(text).alias("text"),
    )
    read = texts.mapInPandas(_named, NAMED)
    read = written(read.withColumn("doc_id", F.col("key").cast(kind)).drop("key"), "sets")
    found = read.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.min(F.struct("lot", "idx", "chk")).alias("at"),
    )
    sets = written(found.select("node", "first_id", "n_shingles", "at.*"), "sets")
    ngrams = read.agg(F.sum("n_shingles")).first()[0] or 0
    labels = linked_sets(texts, sets, ngrams)
    labelled = sets.join(labels, "node", "left").select(
        "node", "first_id", F.coalesce("label", "node").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = labelled.join(smallest, "label").select(
        "node", F.col("label").alias("group"), "component_id"
    )
    some = read.join(written(groups, "groups"), "node")
    none = read.where("n_shingles = 0").select(
        "*", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("component_id")
    )
    columns = ["doc_id", "text_md5", "n_shingles", "component_id", "group"]
    return some.select(columns).unionAll(none.select(columns))


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest id.

    Of rows with that id the one with the smallest digest of its text stays, and one of several
    equal ones. Documents without n-grams are groups of their own and stay; equal ones with one
    id stay once.
    """
    found = near_duplicates(docs, key, text)
    rows = found.groupBy("group", "doc_id", "text_md5").agg(F.count("*").alias("rows"))
    rows = rows.withColumn("row", F.struct(F.col("doc_id").isNull(), "doc_id", "text_md5"))
    first = rows.where("group IS NOT NULL").groupBy("group").agg(F.min("row").alias("first"))
    first = first.withColumnRenamed("group", "g")
    rows = rows.join(first, rows["group"] == first["g"], "left")
    # A document without n-grams is the first of its own group.
    stays = F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    own_id, own_md5 = fresh(docs, "_id", "_md5")
    rows = rows.select(
        F.col("doc_id").alias(own_id), F.col("text_md5").alias(own_md5), "rows", stays.alias("stays")
    )
    # Most documents stay and occur once: only the others are listed, and looked up. The list grows
    # with the corpus, so the texts are dealt out to it at every size, and sorted, which may spill.
    listed = written(rows.where("rows > 1 OR NOT stays"), "listed")
    md5 = F.md5(docs[text].cast("binary"))

    def same(table: DataFrame):
        return docs[key].eqNullSafe(table[own_id]) & md5.eqNullSafe(table[own_md5])

    single = docs.join(listed.hint("merge"), same(listed), "left_anti")
    several = written(listed.where("stays"), "several")
    once = docs.join(several, same(several), "left_semi")
    once = once.withColumn(own_md5, F.md5(F.col(text).cast("binary"))).dropDuplicates([key, own_md5])
    return single.unionAll(once.select(docs.columns))
