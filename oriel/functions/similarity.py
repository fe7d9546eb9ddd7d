"""String similarities: native where Spark has them, bit-parallel or banded ones in Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by one machine integer per row of bits."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """2 * LCS / (len a + len b); two empty strings are alike."""
    total = len(a) + len(b)
    return 1.0 if not total else 2 * lcs_length(a, b) / total


def token_set(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if common and (not only_x or not only_y):
        return 1.0
    base, left, right = " ".join(common), " ".join(common + only_x), " ".join(common + only_y)
    best = indel(left, right)
    return max(best, indel(base, left), indel(base, right)) if base else best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows at the ends may be shorter."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    n, best = len(a), 0.0
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : i + n]
        if 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, indel(a, window))
            if best == 1.0:
                break
    return best


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    n, m = len(a), len(b)
    top = n + m
    d = [[top] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), match  # noqa: E741
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[n + 1][m + 1]


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance, or -1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return -1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cost = a[i - 1] != b[j - 1]
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + cost)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return -1
    return row[-1] if row[-1] <= most else -1


def pairwise(f, kind: T.DataType):
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="object")

    call.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(call, kind)


def ratio(a: Column, b: Column) -> Column:
    return pairwise(indel, T.DoubleType())(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return pairwise(token_set, T.DoubleType())(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return pairwise(partial, T.DoubleType())(a, b)


def damerau_distance(a: Column, b: Column) -> Column:
    return pairwise(damerau, T.IntegerType())(a, b)


def osa_distance(a: Column, b: Column) -> Column:
    return pairwise(osa, T.IntegerType())(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
