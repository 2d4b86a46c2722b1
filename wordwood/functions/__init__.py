"""Column expressions. Nothing here touches a DataFrame or runs a job."""

from wordwood.functions.hashing import fresh, row_hash, uniform
from wordwood.functions.labels import files_for, size_label
from wordwood.functions.text import (
    LINE_END,
    OTHER_WHITESPACE,
    WHITESPACE_CHARS,
    lines,
    stripped,
    tokens,
)

__all__ = [
    "LINE_END",
    "OTHER_WHITESPACE",
    "WHITESPACE_CHARS",
    "files_for",
    "fresh",
    "lines",
    "row_hash",
    "size_label",
    "stripped",
    "tokens",
    "uniform",
]
