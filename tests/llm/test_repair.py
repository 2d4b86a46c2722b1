import hashlib
import random
import re
import zlib

import pytest

from wordwood.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, c string, place string, block string"
STEP = {"": "su", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}
COLUMNS = [
    "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(name.encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(conv, turn, "user" if case == 4 else role, text)] * (case != 0) * (1 + (case == 3))
    return out


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def plain_repair(rows):
    """What one conversation's rows (turn, role, text) come to, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append(
            "blank" if not bare else "duplicate" if (role, text) in seen
            else "truncated" if bare[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    # Of each state the cheapest way on, then the least audit, then what it leaves.
    ways = {"": (0, "", []), "a": (0, "", [])}

    def inserted(ways):
        for _ in range(4):
            for state in STEP:
                for r in set(STEP[state]) & set("ua"):
                    if r in ways:
                        cost, audit, lines = ways[r]
                        new = (cost + 2, "I" + audit, [NAME[r] + ":", *lines])
                        ways[state] = min(ways.get(state, new), new)
        return ways

    ways = inserted(ways)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        before = {}
        for state in STEP:
            options = []
            if state in ways:
                cost, audit, lines = ways[state]
                options.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                for r in STEP[state]:
                    if r not in ways:
                        continue
                    cost, audit, lines = ways[r]
                    cost += fault == "truncated"
                    if role[:1] == r:
                        options.append((cost, "K" + audit, [f"{role}:{text}", *lines]))
                    if r in "ua":
                        options.append((cost + 2, "R" + audit, [f"{NAME[r]}:{text}", *lines]))
            if options:
                before[state] = min(options)
        ways = inserted(before)
    cost, audit, lines = ways[""]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows):
    left = {conv: [] for conv, *_ in rows}
    for conv, *row in plain_damage(rows):
        left[conv].append(row)
    return {conv: plain_repair(own) for conv, own in left.items()}


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = repair.report(repair.damaged(df), df)
    assert got.columns == COLUMNS
    out = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert got.count() == len(out)
    return out


TEXTS = ["Yes.", "No!", "why?", "and then", "x", "", " \t\n", "Ends. \n", "é…", "a.b", ". ", "?"]


def chat(rng, conv, n, fair=0.7):
    """Turns that are mostly as they should be."""
    rows, role = [], "system" if rng.random() < 0.3 else "user"
    for turn in range(n):
        said = role if rng.random() < fair else rng.choice(["system", "user", "assistant", "tool", "s", "ux", "", None])
        text = rng.choice(TEXTS) if rng.random() < 0.3 else f"text {rng.randrange(5 * n)}" + rng.choice([".", "!", ""])
        at = None if rng.random() < 0.05 else turn + 1000 * (rng.random() < 0.03)
        rows.append((conv, at, said, text if rng.random() > 0.03 else None))
        role = "user" if role in ("system", "assistant") else "assistant"
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [r for conv in range(150) for r in chat(rng, conv, rng.randint(1, 14), rng.choice([0.3, 0.7, 0.95]))]
    rows += [r for conv in range(1000, 1006) for r in chat(rng, conv, 90)]
    if seed == 2:
        # Conversations go over many blocks, repeated rows too.
        monkeypatch.setattr(repair, "BLOCK_BITS", 2)
        rows += rng.choices(rows, k=60)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "No id."), (None, None, None, None), (None, 2, "assistant", "Good."),
        (1, None, "user", "x."), (1, None, "assistant", "y."), (2, 5, "", "text."), (3, 1, "", ""),
        (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 2, "assistant", "a."),
        (5, 1, "user", "long " * 60_000 + "end."), (5, 2, "assistant", "short."),
        (6, 2**60, "user", "far."), (6, 2**60 + 1, "assistant", "farther."), (6, -5, "system", "near."),
        (7, 1, "système", "é."), (7, 2, "Üser", "ü."), (7, 3, "assistant:x", "line\nfeed."),
    ]
    rows += [(8, 3, "user", "many copies.")] * 500 + [(8, 4, "assistant", "one.")]
    # Cases that drop every row of a conversation.
    rows += [(c, 0, "user", "gone.") for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    want = brute(rows)
    assert any(w[-2] == "" and w[0] == 0 for w in want.values())
    assert found(spark, rows) == want


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_lines_are_the_conversation(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "Hi."), (2, 1, "user", "ok.")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    lines = repair.repair(df).lines.orderBy("c", "place", "part").collect()
    assert [(r.c, r.lines) for r in lines] == [
        ("1", "user:\nassistant:Hello."), ("1", "user:Hi."), ("1", "assistant:"),
        ("2", "user:ok."), ("2", "assistant:"),
    ]


def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = queries.op12_conversation_repair(spark, sf_dir).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute([tuple(r) for r in rows.collect()])
