"""Tokeniser expressions: built-in functions only, so they stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that Python's str.split() and str.strip() treat as
# whitespace. Java's \s is ASCII only and (?U)\s misses \x1c-\x1f, so they are spelled out.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters but the space, as a Java regex. The rare ones sit behind one range
# test, so an accented letter costs two comparisons and not eleven.
OTHER_WHITESPACE = (
    r"[\t-\r\x1c-\x1f\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)

# Fixed value: what ends a line of a text file.
LINE_END = r"\r\n|\r|\n"


def stripped(col: Column) -> Column:
    """Outer whitespace removed, by the rule of ``str.strip()``."""
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def raw_tokens(col: Column, mode: str) -> Column:
    """Array of tokens in which empty strings may still occur; see :func:`tokens`.

    Both rules end in a split by one literal character, which Java does without a regex.
    """
    if mode == "whitespace":
        return F.split(F.regexp_replace(col, OTHER_WHITESPACE, " "), " ")
    if mode == "space":
        return F.split(stripped(col), " ")
    raise ValueError(f"mode must be 'whitespace' or 'space', not {mode!r}")


def tokens(col: Column, mode: str = "whitespace") -> Column:
    """Array of the non-empty tokens of one line.

    ``whitespace``: any run of Unicode whitespace separates. ``space``: the line is
    stripped, then only the space character separates, so a tab stays inside a token.
    """
    return F.array_remove(raw_tokens(col, mode), "")


def lines(col: Column) -> Column:
    """Array of the lines that a file with this content would have.

    The terminator of the last line does not open another one, and empty text has no lines.
    """
    body = F.regexp_replace(col, rf"(?:{LINE_END})\z", "")
    return F.when(col != "", F.split(body, LINE_END)).otherwise(F.array().cast("array<string>"))
