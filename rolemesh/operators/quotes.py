"""Quotes and fragments found in texts by a normal form that keeps places.

A text's normal form has dashes and apostrophes unified, white space collapsed, and small letters, a character for each character but for white space. A
needle is searched in it as it is; the place of a match in the text follows from how many characters that aren't white space stand before it, and is only
worked out where there is a match. No pattern is built for a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from rolemesh.operators.names import folded

#: Groups of characters that stand for each other in a quote.
DASHES, TICKS, MARKS = "-‐‑‒–—−", "'‘’", "\"“”"
_SAME = str.maketrans({c: group[0] for group in (DASHES, TICKS) for c in group})
_MARKS = str.maketrans(dict.fromkeys(MARKS, MARKS[0]))
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def normal(text: str) -> str:
    return folded(" ".join(text.translate(_SAME).split()))


def is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def places(needle: str, text: str, left: bool = True, right: bool = True) -> Iterator[int]:
    """Where the needle stands in a text of normal form; left, right: no letter, digit or underscore may stand on that side."""
    at = text.find(needle) if needle else -1
    while at >= 0:
        end = at + len(needle)
        if not (left and at and is_word(text[at - 1])) and not (right and end < len(text) and is_word(text[end])):
            yield at
        at = text.find(needle, at + 1)


def contains(fragment: str | None, text: str | None) -> bool:
    """Whether the fragment stands in the text as whole words, whatever case, white space and style of dashes."""
    return bool(fragment and text) and next(places(normal(fragment), normal(text)), None) is not None


def passage(quote: str | None, text: str | None) -> str | None:
    """The passage that the quote copies, as the text writes it; None if there is none, or the quote says nothing."""
    if not quote or not text:
        return None
    needle = normal(quote.translate(_MARKS))
    if not any(map(is_word, needle)):
        return None
    same = normal(text.translate(_MARKS))
    at = next(places(needle, same, is_word(needle[0]), is_word(needle[-1])), None)
    if at is None:
        return None
    solid = np.flatnonzero(~np.isin(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), _SPACES))
    before = at - same.count(" ", 0, at)
    return text[solid[before] : solid[before + len(needle) - needle.count(" ") - 1] + 1]


def line(fragment: str | None, text: str | None) -> str | None:
    """The first line that carries the fragment, as it is."""
    needle = normal(fragment) if fragment else ""
    return next((x for x in (text or "").split("\n") if next(places(needle, normal(x)), None) is not None), None)


def _both(f, kind):
    def each(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if pd.isna(v) else v for v in x)) for x in zip(a, b, strict=True)], dtype=object)

    each.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, kind)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_text(fragment: Column | str, text: Column | str) -> Column:
    """`contains`; false for nulls."""
    return _both(contains, BooleanType())(_column(fragment), _column(text))


def passage_of(quote: Column | str, text: Column | str) -> Column:
    """`passage`."""
    return _both(passage, StringType())(_column(quote), _column(text))


def line_of(fragment: Column | str, text: Column | str) -> Column:
    """`line`."""
    return _both(line, StringType())(_column(fragment), _column(text))
