"""Fuzzy string ratios by longest common subsequences, Arrow-batched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bit vectors (Hyyrö 2004)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * LCS over the total length; 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * lcs_length(a, b) / total if total else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and the shared words with either side's rest; 0 where a side has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    best = ratio(left, right)
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against a window of its length in the longer one, windows over the ends included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


def _column(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run


def token_set_column(a: Column, b: Column) -> Column:
    return _column(token_set_ratio)(a, b)


def partial_column(a: Column, b: Column) -> Column:
    return _column(partial_ratio)(a, b)
