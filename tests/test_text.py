import sys
from collections import Counter

import pyarrow as pa
import pytest
from helpers import as_dict, column
from pyspark.sql import functions as F

from wordwood import operators as op
from wordwood.functions import lines, stripped, tokens
from wordwood.operators import text

LINES = [
    "a\tb c",
    "  x   y ",
    "p q r\x1cs",
    "",
    "  ",
    None,
    "Word word word,",
    "the the the cat cat dog dog \t",
    "　\x85tail",
    "één twee één",
]

RULES = {
    "whitespace": lambda line: line.split(),
    "space": lambda line: [w for w in line.strip().split(" ") if w != ""],
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(line,) for line in LINES], "text string")


@pytest.mark.parametrize("mode", RULES)
def test_word_counts_follow_python(df, mode):
    want = Counter(w for line in LINES if line is not None for w in RULES[mode](line))
    assert as_dict(op.word_counts(df, mode=mode)) == want
    assert op.token_total(df, mode=mode).first()["tokens"] == want.total()
    assert op.distinct_words(df, mode=mode).first()["distinct_words"] == len(want)


@pytest.mark.parametrize("mode", RULES)
def test_token_arrays_follow_python(df, mode):
    got = column(df.where("text is not null").select(tokens(F.col("text"), mode).alias("t")), "t")
    assert got == [RULES[mode](line) for line in LINES if line is not None]


def test_unknown_mode(df):
    with pytest.raises(ValueError, match="mode"):
        op.tokenize(df, mode="tabs")


def test_rules_differ_at_a_tab(spark):
    df = spark.createDataFrame([("a\tb c",)], "text string")
    assert column(op.tokenize(df), "word") == ["a", "b", "c"]
    assert column(op.tokenize(df, mode="space"), "word") == ["a\tb", "c"]


def test_every_character_separates_as_in_python(spark):
    """One row per code point, x<char>y: two words if and only if Python splits there."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    spaces = {c for c in points if chr(c).isspace()}
    low = spark.createDataFrame([(c, f"x{chr(c)}y") for c in range(0x3100)], "c int, text string")
    got = low.where(F.size(tokens(F.col("text"))) == 2)
    assert set(column(got, "c")) == spaces
    assert max(spaces) < 0x3100
    outer = low.where(stripped(F.regexp_replace("text", "[xy]", "")) == "")
    assert set(column(outer, "c")) == spaces | {ord("x"), ord("y")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\r\nb\rc\nd", ["a", "b", "c", "d"]),
        ("a\nb\n", ["a", "b"]),
        ("a\n\n", ["a", ""]),
        ("\n", [""]),
        ("a\r\n", ["a"]),
        ("", []),
        ("one", ["one"]),
    ],
)
def test_lines(spark, text, want, tmp_path):
    df = spark.createDataFrame([(text,)], "text string")
    assert column(op.to_lines(df), "value") == want
    path = tmp_path / "text.txt"
    path.write_bytes(text.encode())
    assert column(spark.read.text(str(path)), "value") == want
    with open(path, encoding="utf-8") as f:
        assert [line.rstrip("\n") for line in f] == want


def test_lines_of_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert op.to_lines(df).count() == 0
    assert df.select(lines(F.col("text")).alias("x")).first()["x"] == []


def test_top_words_breaks_ties_by_word(spark):
    counts = spark.createDataFrame([("d", 2), ("b", 2), ("c", 2), ("a", 3)], "word string, n long")
    assert column(op.top_words(counts, 2), "word") == ["a", "b"]
    assert column(op.top_words(counts, 3), "word") == ["a", "b", "c"]
    plan = op.top_words(counts, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_groups(spark):
    rows = [("x", "a a b"), ("x", "b c"), ("y", "a"), ("y", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert as_dict(op.token_total(df, by=("lang",))) == {"x": 5, "y": 1}
    assert as_dict(op.distinct_words(df, by=("lang",))) == {"x": 3, "y": 1}


def test_same_distinct_but_not_identical(spark):
    a = op.word_counts(spark.createDataFrame([("a b b",)], "text string"))
    b = op.word_counts(spark.createDataFrame([("a c",)], "text string"))
    assert sorted(map(tuple, op.counts_diff(a, b).collect())) == [("b", 2, 0), ("c", 0, 1)]
    row = op.counts_match(a, b).first()
    assert row["same_distinct"] and not row["identical"]
    assert (row["distinct_left"], row["distinct_right"], row["different_words"]) == (2, 2, 2)


def test_a_result_matches_itself(df):
    counts = op.word_counts(df)
    assert op.counts_diff(counts, counts).count() == 0
    row = op.counts_match(counts, counts).first()
    assert row["identical"] and row["same_distinct"] and row["different_words"] == 0


def test_comparison_reuses_the_partitioning(df):
    """A shuffle by word per side, and none for the join."""
    plan = op.counts_diff(op.word_counts(df), op.word_counts(df, mode="space"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2


def test_words_are_counted_ahead_of_the_shuffle(spark):
    """One word in a third of the text: what reaches the shuffle is one row per task."""
    df = spark.range(0, 3000, 1, 4).selectExpr(
        "concat('hot ', cast(id as string), ' w', cast(id % 7 as string)) AS text"
    )
    plan = op.word_counts(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text
    assert plan.where("word = 'hot'").first()["n"] == 3000
    assert plan.agg(F.sum("n")).first()[0] == op.token_total(df).first()["tokens"] == 9000


def test_counts_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = op.word_counts(docs.coalesce(1))
    assert op.counts_match(one, op.word_counts(docs.repartition(7))).first()["identical"]


def test_text_size(spark):
    df = spark.createDataFrame([("é",), ("abc",), ("",)], "text string")
    assert op.text_size_mb(df).first()["size_mb"] == (2 + 1 + 3 + 1 + 0 + 1) / (1024 * 1024)


def test_words_are_summed_before_they_are_rows(spark):
    """No generator: the rows that Spark makes are sums of words, not single tokens."""
    df = spark.createDataFrame([("a b a",)], "text string")
    text = op.word_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("mode", RULES)
def test_word_counts_of_long_texts_and_odd_bytes(spark, monkeypatch, mode):
    texts = ["x\u2003y " * 50, "é\x85ü é", "word " * 2000 + "end", "l" * 3000, " ", "\u3000 a\tb\u00a0c \u3000"]
    monkeypatch.setattr(text, "BYTES_AT_ONCE", 1000)
    batch = pa.RecordBatch.from_pydict({"t": [None, *(t.encode() for t in texts)]})
    got = Counter()
    for sums in text._word_sums(iter([batch]), mode):
        assert sums.num_rows < 60
        got.update(dict(zip(*sums.to_pydict().values(), strict=True)))
    assert got == Counter(w for t in texts for w in RULES[mode](t))
    odd = spark.range(1).selectExpr("cast(X'61FF2062' AS string) AS text")
    assert as_dict(op.word_counts(odd, mode=mode)) == {"a\ufffd": 1, "b": 1}
