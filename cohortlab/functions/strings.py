"""Text functions: name normalisation and similarity ratios."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition, and their plain spelling (fixed values).
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters, from their Unicode decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250))]
    pairs += [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0x1E00, 0x1F00))]
    chosen = [(c, b) for c, b in pairs if b != c and b.isascii() and c == c.lower()]
    return "".join(c for c, _ in chosen), "".join(b for _, b in chosen)


MARKED, BASE = _plain_letters()


def normalize_name(s: Column) -> Column:
    """Lower-case plain letters and digits, single spaces between, none around."""
    x = F.lower(s)
    for a, b in SPELLED.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.translate(x, MARKED, BASE), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(x, " +", " "))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; two empty texts are alike."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with each side's rest. 100 if one side's words are all shared; 0 without words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    join = lambda rest: f"{both} {rest}".strip()
    out = ratio(join(only_x), join(only_y))
    return max(out, ratio(both, join(only_x)), ratio(both, join(only_y))) if both else out


def _sort(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _set(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity of the words in sorted order, 0 to 100."""
    return F.pandas_udf(_sort, "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity that ignores repeated and one-sided words, 0 to 100."""
    return F.pandas_udf(_set, "double")(a, b)
