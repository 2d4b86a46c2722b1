import random
import re
from collections import Counter

import pytest
from llm.helpers import SCHEMA, odd_rows, prose, table, vocabulary

from wordwood.llm import rules
from wordwood.llm.rules import failed_rule, judge

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines, dups, seen = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return n, sum(map(len, words)), symbols, dups, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_against_plain(spark):
    rng = random.Random(1)
    few, many = vocabulary(1, 12), vocabulary(2, 300)
    rows = odd_rows()
    for i in range(200):
        words = rng.choice([few, many])
        lines = [prose(rng, words, rng.randint(0, 12)) + rng.choice([".", "", "###", " | <b>"]) for _ in range(8)]
        rows.append((100 + i, "\n".join(lines + rng.choices(lines, k=rng.randint(0, 5))), "a"))
    got = rules.clean(table(spark, rows), cleaned=False).collect()
    want = Counter((i, *plain_base(t)) for i, t, _ in rows)
    assert want == Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in got
    )
    assert not any(r.kept and r.base_failed for r in got)


def test_repeats_among_very_many_words():
    words = [str(i).encode() for i in range((1 << 20) + 10)]
    assert rules.repeated_words(words) == 0
    assert rules.repeated_words([*words, *words[:5]]) == 10


@pytest.mark.parametrize(
    "line,rule",
    [
        ("A normal sentence, with words in it.", ""),
        ("Is it? Yes!", ""),
        ("Short title", ""),
        ("a line of words without any end", "punctuation"),
        ("Home | News | Sport | Weather", "navigation"),
        ("of### the*** and&&& more$$$ words%%% here.", "boilerplate"),
        ("BUY!! THIS!! NOW!! OR!! NEVER!!", "boilerplate"),
        ("word word word word other other other.", "boilerplate"),
        ("Read our privacy policy.", "boilerplate"),
        ("NATO and the EU met in Berlin.", ""),
        ("He paid $5 for 3 * 4 items in all, and was glad.", ""),
    ],
)
def test_lines(line, rule):
    phrases = [p for p in rules.PHRASES if p in line.lower()]
    assert failed_rule(line, line.encode().split(), phrases) == rule


def sentences(n, start=0):
    rng, words = random.Random(start), vocabulary(4)
    return [f"{prose(rng, words, 9)} {i}.".capitalize() for i in range(n)]


def test_documents():
    good = "\n".join(sentences(20))
    assert judge(good)[7] and judge(good)[8] == good
    some = "\n".join([*sentences(20), "Home | News | Sport", "see our cookie policy here"])
    verdict = judge(some)
    assert verdict[7] and verdict[8] == good and verdict[5] == 10
    junk = "\n".join([*sentences(4), *[line.upper() + "!!" for line in sentences(30, 1)]])
    assert not judge(junk)[7] and not judge(junk)[6]
    # A line may stand twice; from the third time on it is boilerplate.
    again = judge("\n".join([*sentences(10), "Same line once more.", "Same line once more.", "Same line once more."]))
    assert again[3] == 2 and again[5] == 4


def test_empty_table_and_null(spark):
    assert rules.clean(spark.createDataFrame([], SCHEMA)).collect() == []
    r = rules.clean(table(spark, [(1, None, "a")])).first()
    assert (r.n_words, r.kept, r.base_failed, r.cleaned) == (0, False, True, "")


def test_labelled_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rules.clean(docs, cleaned=False).join(labels, "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in got)
