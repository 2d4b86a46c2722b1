"""Repair of conversations whose turns are missing, empty, repeated or in the wrong role.

A conversation is put right by the cheapest edits that make its roles ``(s?(ua)+)?``: rows are kept,
given another role or deleted, and empty turns are inserted. Of equally cheap ways the one whose audit,
a letter for each edit, is the least text.

Where a row may stand depends on one of four states, so a run of rows is a table of four by four
costs, and the runs of a conversation are combined in doubling lengths. The arcs between states that lie
on a cheapest way are then ranked by what audit is possible from there: by its first letter, then
by its first two, four, eight letters, until all ways have ended. At each state the arc with the
least letter, then the least rank, leads on; following these by doubled steps gives all edits.

Rows are sorted once, without their texts, and worked on in blocks of a bounded number of rows.
A conversation that goes over several blocks, however long, takes part with a table of costs for
each of them; only these are chained. Texts are moved last, for the rows that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordwood.llm.common import written

# Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States: nothing yet, after s, after u, after a. Roles: s, u, a, another.
STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
ACCEPTED = np.array([True, False, False, True])
ROLES = {"s": 0, "u": 1, "a": 2}
NAMES = ["system", "user", "assistant"]
LEGAL = {"su", "ua", "au"}

# Arcs out of a state, in the order of their letters: insert and rerole are there for u and a.
LETTERS = np.frombuffer(b"DIIKRR", np.uint8)
ARC_ROLE = np.array([-1, 1, 2, -1, 1, 2])

FAR = 1 << 40

# Rows of a block, as a power of two.
BLOCK_BITS = 12

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with the damage that the checksum of conversation and turn says; nulls are a space.

    Of 20 cases, 0 drops the row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it and 4
    makes it a user's. Returns ``conv_id, turn, role, text``.
    """
    def space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    case = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    plain = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(case == 4, F.lit("user")).otherwise(space(role)).alias("role"),
        F.when(case == 1, F.lit(""))
        .when(case == 2, F.translate(space(text), ".!?", ""))
        .otherwise(space(text))
        .alias("text"),
        case.alias("case"),
    )
    copies = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return plain.where("case <> 0").withColumn("copy", F.explode(copies)).drop("case", "copy")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of going through a, then b: the least sums."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR)


def _insert_costs() -> np.ndarray:
    """Costs between states by insertions alone."""
    costs = np.where(np.eye(4, dtype=bool), 0, FAR)
    for role in (1, 2):
        for state in range(4):
            if STEP[state, role] >= 0:
                costs[state, STEP[state, role]] = min(costs[state, STEP[state, role]], INSERT)
    for _ in range(2):
        costs = _product(costs[None], costs[None])[0]
    return costs


class Graph:
    """The rows of several runs, one after the other, each with a place behind its last row.

    ``starts`` are the rows at which runs begin. Of each row: ``role`` is 0 to 3, ``must_go`` says that
    it is to be deleted, ``extra`` counts copies that follow it and are deleted, ``late``
    that it costs to keep.
    """

    def __init__(self, starts, role, must_go, extra, late):
        runs, rows = len(starts), len(role)
        self.run = np.repeat(np.arange(runs), np.diff(np.append(starts, rows)))
        self.at = np.arange(rows) + self.run
        self.first = starts + np.arange(runs)
        self.last = np.append(self.first[1:], rows + runs) - 1
        n = self.n = rows + runs
        self.row = np.full(n, -1)
        self.row[self.at] = np.arange(rows)
        self.extra = np.zeros(n, np.int64)
        self.extra[self.at] = extra
        # Costs and next states of the six arcs, from each place and state.
        self.cost = np.full((n, 4, 6), FAR)
        self.to = np.tile(np.arange(4)[None, :, None], (n, 1, 6))
        more = DELETE * extra
        self.cost[self.at, :, 0] = (DELETE + more)[:, None]
        stays = ~must_go
        for arc, code in ((1, 1), (2, 2), (4, 1), (5, 2)):
            able = STEP[:, code] >= 0
            self.to[:, able, arc] = STEP[able, code]
            if arc < 3:
                self.cost[:, able, arc] = INSERT
            else:
                price = np.where(stays, REROLE + TRUNCATED * late + more, FAR)
                self.cost[self.at[:, None], np.flatnonzero(able), arc] = price[:, None]
        kept = STEP[:, role].T
        able = (kept >= 0) & stays[:, None]
        self.cost[self.at, :, 3] = np.where(able, (TRUNCATED * late + more)[:, None], FAR)
        self.to[self.at, :, 3] = np.maximum(kept, 0)

    def tables(self) -> np.ndarray:
        """Costs from each place and state to each state behind the last row of the run."""
        own = np.full((self.n, 4, 4), FAR)
        for arc in (0, 3, 4, 5):
            for state in range(4):
                there = np.arange(self.n), state, self.to[:, state, arc]
                own[there] = np.minimum(own[there], self.cost[:, state, arc])
        costs = _product(np.broadcast_to(_insert_costs(), own.shape), own)
        costs[self.last] = np.where(np.eye(4, dtype=bool), 0, FAR)
        jump = np.arange(self.n) + 1
        jump[self.last] = self.last
        ends = np.isin(np.arange(self.n), self.last)
        while not ends[jump].all():
            costs = _product(costs, costs[jump])
            jump = jump[jump]
        return costs

    def solve(self, tables: np.ndarray, behind: np.ndarray, open_end: np.ndarray) -> None:
        """Find the least audits. ``behind`` has the costs behind each run's last row.

        Where ``open_end``, the conversation goes on in another run, and insertions there belong to it.
        """
        run = np.empty(self.n, np.int64)
        run[self.at] = self.run
        run[self.last] = np.arange(len(self.last))
        goal = behind[run]
        if not open_end.all():
            closed = ~open_end[run]
            goal[closed] = (_insert_costs()[None] + goal[closed][:, None, :]).min(2)
        self.least = np.minimum((tables + goal[:, None, :]).min(2), FAR)
        cost = self.cost.copy()
        cost[self.last[open_end]] = FAR
        ahead = np.minimum(np.arange(self.n) + 1, self.n - 1)
        place = np.where(np.array([0, 1, 1, 0, 0, 0], bool), np.arange(self.n)[:, None], ahead[:, None])
        target = place[:, None, :] * 4 + self.to
        total = cost + self.least.reshape(-1)[target]
        best = (total == self.least[:, :, None]) & (self.least < FAR)[:, :, None]
        # Behind the last row an audit may end; insertions would only cost.
        best = best.reshape(-1, 6)
        self.target, self.ended = target.reshape(-1, 6), ~best.any(1)
        rank = self._ranked(best)
        key = LETTERS[None, :].astype(np.int64) * (rank.max() + 2) + rank[self.target]
        self.arc = np.where(best, key, np.iinfo(np.int64).max).argmin(1)
        self.next = np.where(
            self.ended, np.arange(4 * self.n), self.target[np.arange(4 * self.n), self.arc]
        )

    def _ranked(self, best: np.ndarray) -> np.ndarray:
        """The rank of the least audit from each place and state, by doubled lengths.

        Several ways can have the same letters. They end at one place, so a set of its
        four states is kept, and of these only the ones from which the least goes on.
        """
        nodes = np.arange(4 * self.n)
        letter = np.where(best, LETTERS, 255).min(1)
        chosen = best & (letter[:, None] == LETTERS)
        rank = np.unique(np.where(self.ended, 0, letter), return_inverse=True)[1]
        states = np.where(chosen, 1 << (self.target % 4), 0)
        states = np.where(self.ended, 1 << (nodes % 4), np.bitwise_or.reduce(states, axis=1))
        first = self.target[nodes, chosen.argmax(1)]
        place = np.where(self.ended, nodes, first) // 4
        while True:
            there = place[:, None] * 4 + np.arange(4)
            inside = (states[:, None] >> np.arange(4)) & 1 == 1
            if self.ended[there][inside].all():
                return rank
            further = np.where(inside, rank[there], np.iinfo(np.int64).max)
            least = further.min(1)
            on = further == least[:, None]
            place = place[there[np.arange(len(there)), on.argmax(1)]]
            states = np.bitwise_or.reduce(np.where(on, states[there], 0), axis=1)
            rank = np.unique(rank * (rank.max() + 1) + least, return_inverse=True)[1]

    def paths(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least ways from some nodes: way and node of each edit in order, and where each ends."""
        way, node, step = np.arange(len(starts)), starts, np.zeros(len(starts), np.int64)
        way, node, step = (x[~self.ended[starts]] for x in (way, node, step))
        doubled, length = self.next, 1
        while len(node):
            more = doubled[node]
            on = ~self.ended[more]
            if not on.any():
                break
            way, step = np.append(way, way[on]), np.append(step, step[on] + length)
            node = np.append(node, more[on])
            doubled, length = doubled[doubled], 2 * length
        order = np.lexsort((step, way))
        last = doubled
        while not self.ended[last[starts]].all():
            last = last[last]
        return way[order], node[order], last[starts]


def _graph(rows: pd.DataFrame) -> tuple[Graph, np.ndarray, dict[str, np.ndarray]]:
    """The runs of a block, sorted, and their rows' columns as arrays."""
    columns = {c: rows[c].to_numpy() for c in ("c", "copies", "blank", "late", "first", "role", "place")}
    c = columns["c"]
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    initial = np.array([r[:1] for r in columns["role"]], dtype=object)
    code = np.array([ROLES.get(i, 3) for i in initial])
    copies, stays = columns["copies"].astype(np.int64), (columns["first"] & ~columns["blank"]).astype(bool)
    graph = Graph(starts, code, ~stays, copies - 1, columns["late"].astype(bool) & stays)
    return graph, starts, columns | {"initial": initial, "stays": stays, "copies": copies}


def _edge_tables(rows: pd.DataFrame) -> pd.DataFrame:
    """Costs through the first and the last run of a block: only these may go on elsewhere."""
    rows = rows.sort_values("place")
    graph, starts, columns = _graph(rows)
    tables = graph.tables()
    runs = sorted({0, len(starts) - 1})
    return pd.DataFrame(
        {
            "c": [columns["c"][starts[r]] for r in runs],
            "block": [rows["block"].iloc[0]] * len(runs),
            "costs": [tables[graph.first[r]].reshape(-1) for r in runs],
        }
    )


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a conversation over several blocks, the costs behind each of its runs."""
    rows = rows.sort_values("block", ascending=False)
    behind, out = np.where(ACCEPTED, 0, FAR), []
    if len(rows) > 1:
        behind = (_insert_costs() + behind).min(1)
        for k, (c, block, costs) in enumerate(zip(rows["c"], rows["block"], rows["costs"], strict=True)):
            out.append((c, block, k > 0, behind))
            behind = np.minimum((np.reshape(costs, (4, 4)) + behind).min(1), FAR)
    return pd.DataFrame(out, columns=["c", "block", "goes_on", "behind"])


RUNS = (
    "c string, block long, chained boolean, entry int, exit int, cost long, audit string, "
    "places array<long>, heads array<string>, tail string, blank long, duplicate long, "
    "truncated long, illegal long, turns long, least long, most long, first_turn long, "
    "last_turn long, first_initial string, last_initial string"
)


def _counts(rows: pd.DataFrame, starts: np.ndarray, columns: dict) -> dict[str, np.ndarray]:
    """What is counted of each run before it is repaired."""
    ends = np.append(starts[1:], len(rows))
    begins = np.zeros(len(rows), bool)
    begins[starts] = True

    def added(values) -> np.ndarray:
        return np.add.reduceat(np.asarray(values, np.int64), starts)

    copies, blank, stays = columns["copies"], columns["blank"].astype(bool), columns["stays"]
    initial = columns["initial"]
    pairs = np.append("", initial[:-1]) + initial
    wrong = ~begins & ~np.isin(pairs.astype(str), list(LEGAL))
    known, turn = rows["known"].to_numpy(), rows["turn"].to_numpy()
    new = known & (begins | np.append(True, (turn[1:] != turn[:-1]) | ~known[:-1]))
    big = np.iinfo(np.int64)
    n_known = added(known)
    # Null turns come first, so those that are known are the last of a run.
    first_known = np.minimum(ends - n_known, len(rows) - 1)
    return {
        "blank": added(copies * blank),
        "duplicate": added(np.where(blank, 0, copies - stays)),
        "truncated": added(columns["late"].astype(bool) & stays),
        "illegal": added(copies - 1 + wrong),
        "turns": added(new),
        "least": np.minimum.reduceat(np.where(known, turn, big.max), starts),
        "most": np.maximum.reduceat(np.where(known, turn, big.min), starts),
        "known": n_known > 0,
        "first_turn": turn[first_known],
        "last_turn": turn[ends - 1],
        # A turn goes on from another block only if it is known in the run's first row.
        "starts_known": known[starts],
        "first_initial": initial[starts],
        "last_initial": initial[ends - 1],
    }


def _lines(graph: Graph, columns: dict, nodes: np.ndarray) -> tuple[list[int], list[str], str]:
    """What stays of a run: places of rows, what stands before each text, and what comes last."""
    places, heads, before = [], [], []
    for node, arc in zip(nodes.tolist(), graph.arc[nodes].tolist(), strict=True):
        if arc in (1, 2):
            before.append(f"{NAMES[ARC_ROLE[arc]]}:")
        elif arc >= 3:
            row = graph.row[node // 4]
            role = columns["role"][row] if arc == 3 else NAMES[ARC_ROLE[arc]]
            places.append(int(columns["place"][row]))
            heads.append("\n".join([*before, f"{role}:"]))
            before = []
    return places, heads, "\n".join(before)


def _repaired(rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The runs of a block, repaired; those of longer conversations from each state they may start in."""
    if rows.empty:
        return pd.DataFrame(columns=[f.split()[0] for f in RUNS.split(", ")])
    rows = rows.sort_values("place")
    graph, starts, columns = _graph(rows)
    counts = _counts(rows, starts, columns)
    names = columns["c"][starts]
    known = {c: (on, behind) for c, on, behind in zip(ends["c"], ends["goes_on"], ends["behind"], strict=True)}
    closed = np.where(ACCEPTED, 0, FAR)
    behind = np.array([known[c][1] if c in known else closed for c in names])
    goes_on = np.array([c in known and bool(known[c][0]) for c in names])
    # The costs behind a last run are those of the end itself.
    behind[~goes_on] = closed
    graph.solve(graph.tables(), behind, goes_on)
    chained = np.array([c in known for c in names])
    ways = [(r, q) for r, c in enumerate(chained) for q in (range(4) if c else (0,))]
    run, entry = np.array(ways).T
    begin = graph.first[run] * 4 + entry
    able = graph.least.reshape(-1)[begin] < FAR
    run, entry, begin = run[able], entry[able], begin[able]
    way, node, last = graph.paths(begin)
    letters = LETTERS[graph.arc[node]]
    more = np.where(np.isin(graph.arc[node], (0, 3, 4, 5)), graph.extra[node // 4], 0)
    text = np.full(len(node) + int(more.sum()), ord("D"), np.uint8)
    text[np.cumsum(more + 1) - more - 1] = letters
    sizes = np.bincount(way, more + 1, minlength=len(run)).astype(np.int64)
    audits = [t.tobytes().decode() for t in np.split(text, np.cumsum(sizes)[:-1])]
    edits = np.split(node, np.cumsum(np.bincount(way, minlength=len(run)))[:-1])
    lines = [_lines(graph, columns, e) for e in edits]
    out = last % 4
    left = np.where(goes_on[run], behind[run, out], 0)
    frame = pd.DataFrame(
        {
            "c": names[run],
            "block": rows["block"].iloc[0],
            "chained": chained[run],
            "entry": entry,
            "exit": out,
            "cost": graph.least.reshape(-1)[begin] - left,
            "audit": audits,
            "places": [p for p, _, _ in lines],
            "heads": [h for _, h, _ in lines],
            "tail": [t for _, _, t in lines],
        }
    )
    for name in ("blank", "duplicate", "truncated", "illegal", "turns", "first_initial", "last_initial"):
        frame[name] = counts[name][run]
    for name in ("least", "most", "last_turn"):
        frame[name] = pd.Series(counts[name][run], dtype="Int64").mask(~counts["known"][run])
    frame["first_turn"] = pd.Series(counts["first_turn"][run], dtype="Int64").mask(~counts["starts_known"][run])
    return frame


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """From the first block on, the state in which each run of a conversation starts."""
    by_block: dict[int, dict[int, object]] = {}
    for row in rows.itertuples():
        by_block.setdefault(row.block, {})[row.entry] = row
    state, before, out = 0, None, []
    for block in sorted(by_block):
        row = by_block[block][state]
        joint = before is not None and before.last_initial + row.first_initial not in LEGAL
        same = before is not None and pd.notna(row.first_turn) and before.last_turn == row.first_turn
        out.append((row.c, block, state, int(joint), int(bool(same))))
        state, before = row.exit, row
    return pd.DataFrame(out, columns=["c", "block", "entry", "joint", "same"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation, whose lines come one after the other."""
    now, digest = None, None
    for batch in batches:
        out = []
        for c, lines in zip(batch["c"], batch["lines"], strict=True):
            if c != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = c, hashlib.sha256(lines.encode())
            else:
                digest.update(b"\n" + lines.encode())
        yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
    if digest:
        yield pd.DataFrame([(now, digest.hexdigest())], columns=["c", "repaired_sha256"])


def _named(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit("\x00null"))


class Repair:
    """The repair of conversations in a table; see :func:`repair`."""

    def __init__(self, report: DataFrame, lines: DataFrame):
        self.report, self.lines = report, lines

    def digests(self) -> DataFrame:
        """``c, repaired_sha256`` of every conversation that has a line. One task reads one conversation, as a stream."""
        rows = self.lines.repartition("c").sortWithinPartitions("c", "place", "part")
        return rows.select("c", "lines").mapInPandas(_digests, "c string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Repair the conversations of a table.

    ``report`` has ``c, gaps, blank, duplicate, truncated, illegal, cost, audit`` for each conversation.
    ``lines`` is what stays: ``c, place, part, lines``, in the order of place and part, where ``lines``
    is a row as ``role:text``, after the turns that were inserted before it. ``c`` is the conversation's
    id as text, null ids being one conversation.

    Rows are in the order of their turns, null first, then role and a digest of the text; equal rows are next
    to each other. Null roles and texts are one space. A role is known by its first character; an empty
    one has none, so it cannot stay. An empty table has no conversation. Other columns are not read.
    """
    read = rows.select(
        _named(F.col(conv)).alias("c"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    read = read.select(
        "*",
        F.md5(F.concat_ws(":", F.length("role"), "role", "text").cast("binary")).alias("digest"),
        (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("late"),
    )
    # Equal rows are summed up before they are moved; their texts stay behind.
    row = ["c", "turn", "role", "digest"]
    compact = read.groupBy(*row).agg(
        F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("late").alias("late")
    )
    compact = written(compact, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("first_at"))
    firsts = compact.groupBy("c", "digest").agg(F.min(order).alias("at"))
    flagged = compact.join(firsts, ["c", "digest"]).select(
        *row, "copies", "blank", "late", F.col("turn").eqNullSafe(F.col("at.first_at")).alias("first")
    )
    placed = flagged.repartitionByRange(*row).sortWithinPartitions(*row)
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("block", F.shiftright("place", BLOCK_BITS)), "placed")

    # Null turns as a mark, as pandas would make doubles of the others.
    known = F.col("turn").isNotNull()
    work = placed.drop("digest").withColumns({"known": known, "turn": F.coalesce("turn", F.lit(0))})
    edges = work.groupBy("block").applyInPandas(_edge_tables, "c string, block long, costs array<long>")
    ends = edges.groupBy("c").applyInPandas(
        _chained, "c string, block long, goes_on boolean, behind array<long>"
    )
    ends = written(ends, "ends")
    runs = work.groupBy("block").cogroup(ends.groupBy("block")).applyInPandas(_repaired, RUNS)
    runs = written(runs, "runs")
    turns = [F.col(x).cast("string").alias(x) for x in ("first_turn", "last_turn")]
    small = ["c", "block", "entry", "exit", *turns, "first_initial", "last_initial"]
    chosen = runs.where("chained").select(*small).groupBy("c").applyInPandas(
        _chosen, "c string, block long, entry int, joint long, same long"
    )
    zero = F.lit(0).cast("bigint")
    alone = runs.where("NOT chained").withColumns({"joint": zero, "same": zero})
    runs = alone.unionByName(runs.where("chained").join(chosen, ["c", "block", "entry"]))

    report = runs.groupBy("c").agg(
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - F.col("same")), zero).alias("gaps"),
        F.sum("blank").alias("blank"),
        F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"),
        F.sum(F.col("illegal") + F.col("joint")).alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit"),
    )

    stay = runs.select(F.explode(F.arrays_zip("places", "heads")).alias("x")).select("x.places", "x.heads")
    stay = placed.join(stay.toDF("place", "head"), "place").select(*row, "place", "head")
    texts = read.groupBy(*row).agg(F.first("text").alias("text"))
    same = [stay[k].eqNullSafe(texts[k]) if k == "turn" else stay[k] == texts[k] for k in row]
    lines = stay.join(texts, same).select(
        stay["c"], "place", F.lit(0).alias("part"), F.concat("head", "text").alias("lines")
    )
    last = F.shiftleft(F.col("block") + 1, BLOCK_BITS)
    tails = runs.where("tail <> ''").select("c", last.alias("place"), F.lit(1).alias("part"), F.col("tail").alias("lines"))
    return Repair(report, lines.unionByName(tails))


def report(rows: DataFrame, all_rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repair of ``rows`` for every conversation that ``all_rows`` has.

    Returns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. A conversation
    without rows has zeros, an empty audit and the digest of nothing, as has the text of one of which
    nothing stays.
    """
    found = repair(rows, conv)
    names = all_rows.select(F.col(conv).alias("conv_id")).distinct().withColumn("c", _named(F.col("conv_id")))
    joined = names.join(found.report, "c", "left").join(found.digests(), "c", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
