"""Text work Spark has no expression for: Unicode folding, common text, similarity.

Arrow-batched and marked non-deterministic, so that a column which is both filtered
and kept is computed once.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(value: str, table: Mapping[int, str] | None = None) -> str:
    """NFKC, then the caller's character map, no white space, case folded."""
    folded = unicodedata.normalize("NFKC", value)
    if table:
        folded = folded.translate(table)
    return re.sub(r"\s+", "", folded).casefold()


def normalizer(character_map: Mapping[str, str] | None = None):
    """A column function; ``character_map`` folds one script to another per character."""
    table = {ord(k): v for k, v in (character_map or {}).items()}

    @F.pandas_udf("string")
    def normalize(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fold_text(v, table))

    return normalize.asNondeterministic()


def normalize(col: Column) -> Column:
    return normalizer()(col)


def common_text(left: str, right: str) -> str:
    """Longest common substring, the first longest in ``left``.

    Whether a common piece of length n exists is monotone in n, so the length is found by
    bisection. Pieces of long texts are compared by rolling hashes, so memory stays linear
    in the texts; short ones are compared as they are, which is quicker for them.
    """
    short = len(left) + len(right) <= SHORT
    a, b = (None, None) if short else (_rolling(left), _rolling(right))

    def first_of_length(n: int) -> int:
        if short:
            pieces = {right[i:i + n] for i in range(len(right) - n + 1)}
            return next((i for i in range(len(left) - n + 1) if left[i:i + n] in pieces), -1)
        ours, theirs = _pieces(*a, n), _pieces(*b, n)
        for i in np.flatnonzero(np.isin(ours, theirs)).tolist():
            if left[i:i + n] in right:
                return i
        return -1

    low, high, found = 0, min(len(left), len(right)), 0
    while low < high:
        middle = (low + high + 1) // 2
        at = first_of_length(middle)
        if at >= 0:
            low, found = middle, at
        else:
            high = middle - 1
    return left[found:found + low] if low else ""


BASE = 0x9E3779B97F4A7C15
SHORT = 2048


def _rolling(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers of the base, modulo 2**64."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    powers = np.full(len(codes) + 1, BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return sums, powers


def _pieces(sums: np.ndarray, powers: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all pieces of length n, brought to the same power."""
    count = len(sums) - n
    return (sums[n:] - sums[:count]) * powers[:count][::-1] * _shift(count)


def _shift(count: int) -> np.uint64:
    """What is left to bring pieces of texts of any size to one power of the base."""
    return np.uint64(pow(BASE, (1 << 40) - (count - 1), 1 << 64))


def longest_common_text(left: Column, right: Column) -> Column:
    """Shared text of two raw strings, folded whole."""

    @F.pandas_udf("string")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def folded(value: str) -> str:
            if value not in seen:
                seen[value] = fold_text(value)
            return seen[value]

        return pd.Series([common_text(folded(x or ""), folded(y or "")) for x, y in zip(a, b)], dtype=object)

    return shared.asNondeterministic()(left, right)


def similarity(left: Column, right: Column) -> Column:
    """Ratio of matching characters, 0 when either side is empty."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)],
            dtype=float,
        )

    return ratio.asNondeterministic()(left, right)


def normalize_each(values: Column) -> Column:
    """``normalize`` over every element of an array column."""

    @F.pandas_udf("array<string>")
    def each(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: None if a is None else [None if v is None else fold_text(v) for v in a])

    return each.asNondeterministic()(values)
