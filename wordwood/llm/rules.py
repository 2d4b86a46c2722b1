"""Line-first cleaning: rules decide on lines, then the loss decides on the document.

Every line is tested for punctuation, navigation and boilerplate. Lines that fail are removed.
A document that loses more than a set share of its words that way is rejected, and so is one
that fails the base rules on its whole text: too few words, or too many in repeated phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base rules.
MIN_WORDS = 50
MOST_REPEATED_PCT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WIDTH = 3

# The rules on lines.
MOST_LOST_PCT = 60
LINE_ENDS = tuple(".!?:;…\"'”’»)]。！？")
SHORT_LINE = 3
SEPARATOR = re.compile(r"(?<![^ \t])(?:\|\|?|>>?|[»›•·‹«/-])(?![^ \t])")
TWO_CAPITALS = re.compile("[A-Z]{2}")
SEPARATOR_PCT = 20
SYMBOL_PCT = 20
SHOUTED_PCT = 60
SAME_WORD_PCT = 50
MOST_TIMES = 2
PHRASES = (
    "lorem ipsum",
    "enable javascript",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
)
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lost_words long, base_failed boolean, kept boolean, cleaned string"
)


def repeated_words(words: list) -> int:
    """How many words lie in a window of three words that occurs at least twice."""
    n = len(words)
    if n <= REPEAT_WIDTH:
        return 0
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    pairs = ids[:-2] * len(names) + ids[1:-1]
    if len(names) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, count = np.unique(
        pairs * len(names) + ids[2:], return_inverse=True, return_counts=True
    )
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for i in range(REPEAT_WIDTH):
        covered[i : i + n - 2] |= again
    return int(covered.sum())


def failed_rule(line: str, words: list[bytes], phrases: list[str]) -> str:
    """The rule that a line with words fails, or the empty text.

    ``phrases`` are the boilerplate phrases that its text has anywhere.
    """
    n = len(words)
    separators = len(SEPARATOR.findall(line))
    if separators >= 2 and 100 * separators >= SEPARATOR_PCT * n:
        return "navigation"
    if 100 * sum(map(line.count, SYMBOLS)) > SYMBOL_PCT * n and n > 1:
        return "boilerplate"
    if n >= SHORT_LINE:
        if TWO_CAPITALS.search(line):
            shouted = sum(len(w) > 1 and w.decode().isupper() for w in words)
            if 100 * shouted >= SHOUTED_PCT * n:
                return "boilerplate"
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        if n > SHORT_LINE and 100 * same >= SAME_WORD_PCT * n:
            return "boilerplate"
    if phrases and any(p in line.lower() for p in phrases):
        return "boilerplate"
    if n > SHORT_LINE and not line.rstrip(SPACES).endswith(LINE_ENDS):
        return "punctuation"
    return ""


def judge(text: str | None) -> tuple:
    """The columns of ``RESULT`` for one whole text; null counts as empty."""
    text = text or ""
    words = text.encode().split()
    lower = text.lower()
    phrases = [p for p in PHRASES if p in lower]
    times, lost, dups, left = {}, 0, 0, []
    for line in text.split("\n"):
        inside = line.encode().split()
        if not inside:
            left.append(line)
            continue
        times[line] = times.get(line, 0) + 1
        dups += times[line] > 1
        if times[line] > MOST_TIMES or failed_rule(line, inside, phrases):
            lost += len(inside)
        else:
            left.append(line)
    n = len(words)
    repeated = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED_PCT * n
    kept = not base_failed and 100 * lost <= MOST_LOST_PCT * n
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dups,
        repeated,
        lost,
        base_failed,
        kept,
        "\n".join(left),
    )


def _judged(batches: Iterator[pd.Series], cleaned: bool) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    for texts in batches:
        rows = pd.DataFrame([judge(t) for t in texts], columns=names)
        yield rows if cleaned else rows.drop(columns="cleaned")


def clean(
    docs: DataFrame, key: str = "doc_id", text: str = "text", cleaned: bool = True
) -> DataFrame:
    """The verdict on every document, one row per row, and the text without its failed lines.

    Returns ``doc_id`` and the columns of ``RESULT`` (without the text if ``cleaned`` is off).
    Null and empty texts have no words and fail. Repeated rows and null ids are judged like any
    others; other columns are not read. No rows are moved.
    """
    kind = RESULT if cleaned else RESULT.rsplit(", ", 1)[0]

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _judged(batches, cleaned)

    rows = docs.select(F.col(key).alias("doc_id"), judged(F.col(text)).alias("verdict"))
    return rows.select("doc_id", "verdict.*")
