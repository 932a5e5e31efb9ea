"""Tail probabilities for aggregated test rows.

Each function maps a few numbers of one test to its p-value; the ranks and sums
come from Spark. Exact counts are used for small samples without ties, normal
approximations otherwise.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

EXACT_U_SMALL = 8
EXACT_W = 50
EXACT_SIGN = 500


@lru_cache(maxsize=64)
def _u_tail(n1: int, n2: int) -> np.ndarray:
    """Number of rank arrangements with a U of at most 0, 1, ... up to the middle.

    The counts per value are the Gaussian binomial coefficients. Only the lower half is
    formed, where they start small; the upper half mirrors it.
    """
    counts = np.zeros(n1 * n2 // 2 + 1)
    counts[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i < len(counts):
            counts[n2 + i :] -= counts[: -(n2 + i)].copy()
        padded = np.concatenate([counts, np.zeros(-len(counts) % i)]).reshape(-1, i)
        counts = np.cumsum(padded, axis=0).ravel()[: len(counts)]
    return np.cumsum(counts)


@lru_cache(maxsize=256)
def _w_counts(n: int) -> tuple[float, ...]:
    """Number of sign patterns per value of the positive rank sum."""
    counts = [1.0] + [0.0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for w in range(len(counts) - 1, rank - 1, -1):
            counts[w] += counts[w - rank]
    return tuple(counts)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def mann_whitney(u1: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided p of U; ``tie_term`` is the sum of t^3 - t over tied values."""
    small, large = min(n1, n2), max(n1, n2)
    u = max(u1, n1 * n2 - u1)
    if tie_term == 0 and small <= EXACT_U_SMALL:
        at_most = n1 * n2 - int(math.ceil(u - 1e-9))  # mirrored to the lower half
        return min(1.0, 2.0 * float(_u_tail(small, large)[at_most]) / math.comb(n1 + n2, n1)) if at_most >= 0 else 0.0
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    return min(1.0, 2.0 * normal_tail((u - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)))


def signed_rank(w_plus: float, n: int, tie_term: float, correct: bool, allow_exact: bool) -> float | None:
    """Two-sided p of the signed-rank sum over ``n`` non-zero differences."""
    if n == 0:
        return None
    top = n * (n + 1) / 2.0
    if allow_exact and tie_term == 0 and n <= EXACT_W:
        counts = _w_counts(n)
        w = max(w_plus, top - w_plus)
        return min(1.0, 2.0 * sum(counts[int(math.ceil(w - 1e-9)):]) / 2.0**n)
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    if variance <= 0:
        return 1.0
    gap = abs(w_plus - top / 2.0) - (0.5 if correct else 0.0)
    return min(1.0, 2.0 * normal_tail(gap / math.sqrt(variance)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value / a


def sign_test(positive: int, negative: int) -> float | None:
    """Exact two-sided binomial p with probability one half."""
    n = positive + negative
    if n == 0:
        return None
    k = max(positive, negative)
    if 2 * k == n:
        return 1.0
    if n <= EXACT_SIGN:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n)
    return min(1.0, 2.0 * incomplete_beta(k, n - k + 1.0, 0.5))


def f_tail(f: float, df1: float, df2: float) -> float:
    if not math.isfinite(f):
        return 0.0
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def _series(rows, fn) -> pd.Series:
    missing = lambda v: v is None or v != v
    return pd.Series([None if any(missing(v) for v in r) else fn(*r) for r in rows], dtype="float64")


@pandas_udf(DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series) -> pd.Series:
    return _series(zip(u1, n1, n2, tie_term), lambda u, a, b, t: mann_whitney(u, int(a), int(b), t))


@pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, tie_term: pd.Series) -> pd.Series:
    return _series(zip(w, n, tie_term), lambda a, b, t: signed_rank(a, int(b), t, False, True))


@pandas_udf(DoubleType())
def signed_rank_normal_p(w: pd.Series, n: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Always the normal rule with continuity correction."""
    return _series(zip(w, n, tie_term), lambda a, b, t: signed_rank(a, int(b), t, True, False))


@pandas_udf(DoubleType())
def sign_test_p(positive: pd.Series, negative: pd.Series) -> pd.Series:
    return _series(zip(positive, negative), lambda a, b: sign_test(int(a), int(b)))


@pandas_udf(DoubleType())
def f_tail_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _series(zip(f, df1, df2), f_tail)
