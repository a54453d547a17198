"""Text helpers with Python string semantics, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes and str.splitlines() splits on.
_PY_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), rf"^[{_PY_SPACE}]+|[{_PY_SPACE}]+\z", "")


def split_lines(col: Column | str) -> Column:
    """``str.splitlines()``: no trailing empty line, [] for ''."""
    c = _c(col)
    body = F.regexp_replace(c, rf"({_LINE_BREAK})\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, _LINE_BREAK))
