"""Removal of repeated byte strings over a whole corpus, by suffix sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a document with
a smaller id, or further up in the same one. All such strings must meet where they are compared,
and no task can hold all suffixes. So each string has an anchor: the place inside it whose next
few bytes have the smallest hash. Equal strings have equal anchors at equal places, so what starts
with the same few bytes goes to the same task.

1. Anchors alone are counted. Those of which there is one in the corpus are in no repeat.
2. Around the others, the bytes of the strings they stand for go to the fragment of the anchor.
   Strings at neighbouring places are kept together as a piece.
3. Pieces that agree in the bytes all their strings have (the core) are a group. Where a group has
   one piece only, however often, its first occurrence stays. Where it has several, the suffixes
   of these pieces are sorted by grouping (:mod:`wordwood.llm.grouping`), and strings that stand
   next to each other and are equal have one first occurrence. A group that is too large for that
   is cut into shorter pieces with longer cores first.
4. What is covered is cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordwood.llm.common import fragments_for, total_bytes
from wordwood.llm.grouping import suffix_order

# Fixed value: bytes of a string that counts as repeated.
LENGTH = 100

# Bytes that are hashed for an anchor, and strings that a piece holds.
GRAM = 20
PIECE = 16

# Bytes of text handled at a time, text that one fragment stands for, fragments there are at
# least, and most bytes whose suffixes are sorted together: a larger group is cut into shorter
# pieces first. These bound the memory of a task.
BYTES_AT_ONCE = 1 << 20
BYTES_PER_FRAGMENT, LEAST_FRAGMENTS = 8 << 20, 24
SORTED_AT_ONCE = 1 << 17

BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    with np.errstate(over="ignore"):
        factor = np.uint64(base)
        while filled < n:
            more = min(filled, n - filled)
            out[filled : filled + more] = out[:more] * factor
            factor = factor * factor
            filled *= 2
    return out


class Hashes:
    """Hashes of all substrings of a byte array, by prefix sums: place and length do not show."""

    inverse = pow(BASE, -1, 1 << 64)

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(self.inverse, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
            h = (h ^ (h >> np.uint64(32))) * MIX
            return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of texts that are laid end to end.

    Returns for each its text, the hash of its bytes, its place in ``data`` and the places of
    the first and last string that it stands for.
    """
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    places = np.arange(len(data) - GRAM + 1)
    grams = Hashes(data).of(places, places + GRAM)
    # The smallest hash among those of a string, then the leftmost: both in one number.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    starts = np.flatnonzero(np.arange(LENGTH, len(data) + 1) <= ends[doc[:n]])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) > 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))[: len(first)] - 1
    at = at[first]
    return doc[starts[first]], grams[at], at, starts[first], starts[last]


def _texts_at_once(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of about ``BYTES_AT_ONCE``; the text comes first in a row."""
    held, size = [], 0
    for row in rows:
        if len(row[0]) < LENGTH:
            continue
        held.append(row)
        size += len(row[0])
        if size >= BYTES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    # Anchors are small hashes, being the least of many: mixed again they spread evenly.
    with np.errstate(over="ignore"):
        grams = (grams ^ (grams >> np.uint64(31))) * MIX
    return ((grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _anchor_rows(batches: Iterator[pd.DataFrame], fragments: int) -> Iterator[pd.DataFrame]:
    """The anchors of many texts together, one row for each fragment that has some, of those texts alone."""
    rows = (row for b in batches for row in zip(b["raw"], b["text_key"], strict=True))
    for held in _texts_at_once(rows):
        held = list({key: (raw, key) for raw, key in held}.values())
        doc, grams, *_ = anchors(*_laid_out([raw for raw, _ in held]))
        at = _fragment(grams, fragments)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(fragments + 1))
        out = []
        for f in np.flatnonzero(np.diff(bounds)).tolist():
            part = order[bounds[f] : bounds[f + 1]]
            used, counts = np.unique(doc[part], return_counts=True)
            keys = b"".join(held[i][1] for i in used)
            out.append((f, keys, counts.astype(np.int32).tobytes(), grams[part].tobytes()))
        yield pd.DataFrame(out, columns=["fragment", "keys", "counts", "grams"])


def _repeated_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """The anchors of each text that occur again, there or elsewhere. Equal texts count once."""
    seen: set[bytes] = set()
    keys, parts = [], []
    for names, counts, grams in zip(rows["keys"], rows["counts"], rows["grams"], strict=True):
        counts, grams = np.frombuffer(counts, np.int32), np.frombuffer(grams, np.uint64)
        ends = np.cumsum(counts)
        for i in range(len(counts)):
            key = names[16 * i : 16 * i + 16]
            if key not in seen:
                seen.add(key)
                keys.append(key)
                parts.append(grams[ends[i] - counts[i] : ends[i]])
    if not parts:
        return pd.DataFrame({"text_key": [], "grams": []})
    grams = np.concatenate(parts)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(grams), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    found, at = [], 0
    for key, part in zip(keys, parts, strict=True):
        kept = part[again[at : at + len(part)]]
        at += len(part)
        if len(kept):
            found.append((key, np.unique(kept).tobytes()))
    return pd.DataFrame(found, columns=["text_key", "grams"])


def _context_rows(batches: Iterator[pd.DataFrame], fragments: int) -> Iterator[pd.DataFrame]:
    """The bytes around the anchors that occur again, one row per fragment for many texts."""
    rows = (
        row
        for b in batches
        for row in zip(b["raw"], b["text_key"], b["order_id"], b["marks"], strict=True)
    )
    for held in _texts_at_once(rows):
        data, sizes = _laid_out([r[0] for r in held])
        doc, grams, at, first, last = anchors(data, sizes)
        wanted = np.zeros(len(grams), bool)
        bounds = np.searchsorted(doc, np.arange(len(held) + 1))
        for i, (_, _, _, marks) in enumerate(held):
            own = np.concatenate([np.frombuffer(m, np.uint64) for m in marks])
            part = slice(bounds[i], bounds[i + 1])
            wanted[part] = np.isin(grams[part], own)
        doc, grams, at, first, last = (x[wanted] for x in (doc, grams, at, first, last))
        if not len(doc):
            continue
        starts = np.cumsum(sizes) - sizes
        to = _fragment(grams, fragments)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(fragments + 1))
        out = []
        for f in np.flatnonzero(np.diff(bounds)):
            rows_ = order[bounds[f] : bounds[f + 1]]
            used, text = np.unique(doc[rows_], return_inverse=True)
            head = np.stack(
                [
                    grams[rows_].view(np.int64),
                    text,
                    first[rows_] - starts[doc[rows_]],
                    at[rows_] - first[rows_],
                    last[rows_] - first[rows_] + 1,
                ]
            )
            raw = b"".join(data[a : b + LENGTH].tobytes() for a, b in zip(first[rows_], last[rows_]))
            out.append(
                (
                    int(f),
                    b"".join(held[i][1] for i in used),
                    np.array([held[i][2] for i in used], np.int64).tobytes(),
                    head.tobytes(),
                    raw,
                )
            )
        yield pd.DataFrame(out, columns=["fragment", "keys", "ids", "head", "raw"])


def _pieces(raw: bytes, width: int, tag, at, count, place, text, start) -> tuple[np.ndarray, ...]:
    """Strings at neighbouring places of ``raw``, cut into pieces of at most ``width``.

    A range of ``count`` strings begins at ``at``; ``place`` is that of its first string against the
    anchor, and strings whose places fall into the same run of ``width`` are a piece. Returns the
    same of each piece, with the hashes of its core and of all its bytes.
    """
    low = place // width
    number = (place + count - 1) // width - low + 1
    row = np.repeat(np.arange(len(place)), number)
    cell = np.repeat(low - np.cumsum(number) + number, number) + np.arange(number.sum())
    a = np.maximum(cell * width - place[row], 0)
    b = np.minimum(cell * width + width - place[row], count[row])
    hashes = Hashes(np.frombuffer(raw, np.uint8))
    # What all strings of a whole run have in common, also where some of them are not here.
    core_at = at[row] + cell * width + width - 1 - place[row]
    core = hashes.of(core_at, core_at + LENGTH - width + 1) ^ tag[row]
    full = hashes.of(at[row] + a, at[row] + b + LENGTH - 1)
    with np.errstate(over="ignore"):
        core ^= cell.astype(np.uint64) * MIX
        full += (b - a).astype(np.uint64) * MIX + (place[row] + a).astype(np.uint64)
    return tag[row], at[row] + a, b - a, place[row] + a, text[row], start[row] + a, core, full


def _grouped(data: np.ndarray, pieces: tuple, width: int) -> list[tuple]:
    """The strings of these pieces that start earlier in another: texts, first and last starts."""
    *_, text, start, core, full = pieces
    order = np.lexsort((start, text, full, core))
    tag, at, count, place, text, start, core, full = (x[order] for x in pieces)
    new_core = np.append(True, core[1:] != core[:-1])
    new_piece = new_core | np.append(True, full[1:] != full[:-1])
    # Every occurrence of a piece but the first is covered; a repeated row is no other occurrence.
    first = np.flatnonzero(new_piece)[np.cumsum(new_piece) - 1]
    other = (text != text[first]) | (start != start[first])
    found = [(text[other], start[other], (start + count)[other])]

    group = np.cumsum(new_core) - 1
    contested = new_piece & (np.bincount(group[new_piece], minlength=group[-1] + 1) > 1)[group]
    sizes = count + LENGTH - 1
    large = (np.bincount(group, sizes * contested) > SORTED_AT_ONCE)[group]
    for some in _batches(np.flatnonzero(contested & ~large), group, sizes):
        found.append(_sorted_out(data, some, at, count, group, text, start))
    # Too much to sort together: shorter pieces have longer cores, so their groups are smaller.
    # A piece of one string is its own core, so that comes to an end.
    for some in _batches(np.flatnonzero(contested & large), group, sizes):
        raw = b"".join(data[i : i + n].tobytes() for i, n in zip(at[some], sizes[some], strict=True))
        base = np.cumsum(sizes[some]) - sizes[some]
        known = (tag[some], base, count[some], place[some], text[some], start[some])
        finer = _pieces(raw, width // 2, *known)
        found += _grouped(np.frombuffer(raw, np.uint8), finer, width // 2)
    return found


def _covered(rows: pd.DataFrame) -> pd.DataFrame:
    """The strings in one fragment that start earlier elsewhere, as runs of starts per text."""
    heads = [np.frombuffer(h, np.int64).reshape(5, -1) for h in rows["head"]]
    names, ids, shift = [], [], []
    for keys, numbers in zip(rows["keys"], rows["ids"], strict=True):
        shift.append(len(names))
        names += [keys[i : i + 16] for i in range(0, len(keys), 16)]
        ids.append(np.frombuffer(numbers, np.int64))
    ids = np.concatenate(ids)
    # Texts in their order: by id, then key. A text may come in several rows.
    order = sorted(range(len(names)), key=lambda i: (ids[i], names[i]))
    rank, ranked = np.empty(len(names), np.int64), []
    for i in order:
        if not ranked or ranked[-1] != names[i]:
            ranked.append(names[i])
        rank[i] = len(ranked) - 1
    cut = []
    for raw, head, s in zip(rows["raw"], heads, shift, strict=True):
        gram, text, pos, back, count = head
        at = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        ranges = (gram.view(np.uint64), at, count, LENGTH - back, rank[text + s], pos)
        cut.append(_pieces(raw, PIECE, *ranges))
    # Places in the bytes of one row, then in those of all.
    base = np.cumsum([0, *(len(raw) for raw in rows["raw"])])
    data = np.frombuffer(b"".join(rows["raw"]), np.uint8)
    moved = [(c[0], c[1] + i, *c[2:]) for c, i in zip(cut, base, strict=False)]
    pieces = tuple(np.concatenate(x) for x in zip(*moved, strict=True))
    del cut, moved
    found = _grouped(data, pieces, PIECE)
    t, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(t):
        return pd.DataFrame({"text_key": [], "runs": []})
    order = np.lexsort((s, t))
    t, s, e = t[order], s[order], e[order]
    bounds = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    return pd.DataFrame(
        {
            "text_key": [ranked[t[i]] for i in bounds],
            "runs": [
                np.stack([s[i:j], e[i:j]]).astype(np.int64).tobytes()
                for i, j in zip(bounds, [*bounds[1:], len(t)], strict=True)
            ],
        }
    )


def _batches(pieces: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Whole groups of pieces, together about ``SORTED_AT_ONCE`` bytes."""
    if not len(pieces):
        return
    ends = np.cumsum(sizes[pieces])
    last = np.flatnonzero(np.append(np.diff(group[pieces]) > 0, True)) + 1
    first, done = 0, 0
    for end in last:
        if ends[end - 1] - done >= SORTED_AT_ONCE or end == len(pieces):
            yield pieces[first:end]
            first, done = end, ends[end - 1]


def _sorted_out(data, pieces, at, count, group, text, start) -> tuple[np.ndarray, ...]:
    """Strings of these pieces that start earlier in another one: texts, first and last starts."""
    sizes = count[pieces] + LENGTH - 1
    raw = b"".join(data[i : i + n].tobytes() for i, n in zip(at[pieces], sizes, strict=True))
    base = np.cumsum(sizes) - sizes
    piece_at = np.repeat(np.arange(len(pieces)), sizes)
    inside = np.arange(len(raw)) - base[piece_at]
    order = suffix_order(raw)
    order = order[inside[order] < count[pieces][piece_at[order]]]
    # Strings that are equal are next to each other. The same string in two groups is not the
    # same: it cannot be, but for its anchor's hash.
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), LENGTH)
    differ = np.ones(len(order), bool)
    for i in range(1, len(order), 8192):
        j = min(i + 8192, len(order))
        differ[i:j] = (view[order[i:j]] != view[order[i - 1 : j - 1]]).any(1)
    where = pieces[piece_at[order]]
    differ[1:] |= group[where[1:]] != group[where[:-1]]
    t, s = text[where], start[where] + inside[order]
    kind = np.cumsum(differ) - 1
    by = np.lexsort((s, t, kind))
    later = by[1:][kind[by[1:]] == kind[by[:-1]]]
    return t[later], s[later], s[later] + 1


def _cut(raw: bytes, copy: bool, runs: list[bytes]) -> tuple:
    """Bytes, bytes removed, runs of removed bytes and what is left of one text."""
    n = len(raw)
    if copy and n >= LENGTH:
        return n, n, 1, b""
    if not len(runs):
        return n, 0, 0, raw
    edges = np.zeros(n + 1, np.int64)
    for part in runs:
        first, last = np.frombuffer(part, np.int64).reshape(2, -1)
        np.add.at(edges, first, 1)
        np.add.at(edges, last + LENGTH - 1, -1)
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return n, int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep_bytes: bool = True
) -> DataFrame:
    """Every document without the bytes that are repeated from earlier, one row per row.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_bytes``, what is
    left as ``kept``. Strings are judged on the input; a match never crosses documents.

    Null counts as empty; texts under ``LENGTH`` bytes stay. Null ids come after all others.
    Rows with the same id and text are the same document: they come out alike. Rows with the
    same id and other texts are in the order of a digest of their texts. Other columns are not
    read. Texts of any length are handled whole.
    """
    fragments = max(
        LEAST_FRAGMENTS, fragments_for(docs.sparkSession, total_bytes(docs, text), BYTES_PER_FRAGMENT)
    )
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), raw.alias("raw"), F.unhex(F.md5(raw)).alias("text_key")
    )
    texts = base.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))

    found = base.select("raw", "text_key").mapInPandas(
        lambda b: _anchor_rows(b, fragments),
        "fragment int, keys binary, counts binary, grams binary",
    )
    repeated = found.groupBy("fragment").applyInPandas(
        _repeated_anchors, "text_key binary, grams binary"
    )
    marks = repeated.groupBy("text_key").agg(F.collect_list("grams").alias("marks"))

    # Not an equality, which would be a join key: then the texts could not stay where they are.
    is_first = F.col("first_id").isNull() | (F.col("doc_id") <= F.col("first_id"))
    firsts = base.join(texts, "text_key").where(is_first)
    marked = firsts.join(marks, "text_key").select(
        "raw", "text_key", F.coalesce("first_id", F.lit(int(NO_ID))).alias("order_id"), "marks"
    )
    contexts = marked.mapInPandas(
        lambda b: _context_rows(b, fragments),
        "fragment int, keys binary, ids binary, head binary, raw binary",
    )
    covered = contexts.groupBy("fragment").applyInPandas(_covered, "text_key binary, runs binary")
    runs = covered.groupBy("text_key").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [
                _cut(raw, copy, runs if runs is not None else [])
                for raw, copy, runs in zip(b["raw"], b["copy"], b["runs"], strict=True)
            ]
            out = pd.DataFrame(done, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy(object, na_value=None))
            out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
            yield out if keep_bytes else out.drop(columns="kept")

    kind = "doc_id long, n_bytes long, n_removed long, n_spans long"
    kind += (", kept binary" if keep_bytes else "") + ", kept_sha256 string"
    whole = base.join(texts, "text_key").join(runs, "text_key", "left")
    return whole.select(
        "doc_id", "raw", (~F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("copy"), "runs"
    ).mapInPandas(cut, kind)
