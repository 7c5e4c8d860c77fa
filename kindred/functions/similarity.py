"""Similarities and scores as column expressions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """0 if both sets are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    lo, hi = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(lo == 0, 0.0).otherwise(lo / F.nullif(hi, F.lit(0)))


def contained(a: Column, b: Column) -> Column:
    inside = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    return inside(a, b) | inside(b, a)


def different(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)))


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, raised above 0.7 by a common prefix of up to four characters.

    A sign of `a` takes the first free equal sign of `b` in reach. Reaches only move on, so the places of each sign
    form a queue, and the whole takes time in proportion to the lengths.
    """
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[str, deque[int]] = {}
    for j, ch in enumerate(b):
        places.setdefault(ch, deque()).append(j)
    left, taken = [], []
    for i, ch in enumerate(a):
        queue = places.get(ch)
        while queue and queue[0] < i - reach:
            queue.popleft()
        if queue and queue[0] <= i + reach:
            left.append(ch)
            taken.append(queue.popleft())
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True)) // 2
    s = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if s > 0.7:
        p = 0
        while p < min(4, len(a), len(b)) and a[p] == b[p]:
            p += 1
        s += p * 0.1 * (1 - s)
    return s


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _jaro_winklers(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    each = lambda p, q: seen[p, q] if (p, q) in seen else seen.setdefault((p, q), jaro_winkler_text(p, q))
    return pd.Series([[each(p, q) for p, q in zip(x, y, strict=True)] for x, y in zip(a, b, strict=True)])


def jaro_winklers(*pairs: tuple[Column, Column]) -> Column:
    """An array of the similarities of several pairs of texts, for one trip to Python."""
    return _jaro_winklers(F.array(*[p for p, _ in pairs]), F.array(*[q for _, q in pairs]))


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.get(jaro_winklers((a, b)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def f_half(tp: Column, n_true: Column, n_said: Column) -> Column:
    """F0.5 of a reference: 1 if nothing is true or said, 0 if only one side is empty."""
    t, s = n_true, n_said
    return F.when((t == 0) & (s == 0), 1.0).when((t == 0) | (s == 0), 0.0).otherwise(5.0 * tp / (t + 4.0 * s))


def best_f_half(n_true: Column, reachable: Column) -> Column:
    return F.when(n_true == 0, 1.0).when(reachable == 0, 0.0).otherwise(5.0 * reachable / (n_true + 4.0 * reachable))


def platt(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.least(F.greatest(a * score + b, F.lit(-30.0)), F.lit(30.0))))
