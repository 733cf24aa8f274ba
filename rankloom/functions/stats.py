"""Tails and resampling that SQL has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square variable, by the closed forms for odd and even degrees of freedom."""
    if x is None or df is None or df < 1 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(x) * math.sqrt(2 / math.pi)
        for k in range(1, df // 2 + 1):
            total += term
            term *= x / (2 * k + 1)
        return total
    total, term = 0.0, math.exp(-half)
    for k in range(df // 2):
        total += term
        term *= half / (k + 1)
    return total


def normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


@lru_cache(maxsize=64)
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many of the 2**n sets of signs give each sum 0..n(n+1)/2 of positive ranks, by adding one rank after the other."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        for s, c in enumerate(counts):
            longer[s + rank] += c
        counts = longer
    return tuple(counts)


def signed_rank_tail(statistic: float, n: int) -> float:
    """P(W <= statistic) of n untied differences."""
    return sum(signed_rank_counts(n)[: math.floor(statistic) + 1]) / 2**n


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d or 1e-300), 1 + up / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f / a


def correlation_tail(r: float, n: int) -> float:
    """Two-sided p of a correlation of n pairs, by Student's t with n - 2 degrees."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return math.nan
    return 1.0 if r == 0 else 0.0 if abs(r) >= 1 else beta_tail(1 - r * r, (n - 2) / 2, 0.5)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([math.nan if v is None or math.isnan(v) else normal_tail(v) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_p(statistic: pd.Series, n: pd.Series) -> pd.Series:
    """Exact one-sided p; meant for few differences, so more than 1000 give NaN."""
    return pd.Series([signed_rank_tail(w, int(k)) if k <= 1000 else math.nan for w, k in zip(statistic, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_tail(a, int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")


def tau_b_of(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log n steps; 0.0 where a side doesn't vary (or has fewer than two values)."""

    def tied(*columns: np.ndarray) -> int:
        n = np.unique(np.stack(columns), axis=1, return_counts=True)[1].astype(object)
        return int((n * (n - 1) // 2).sum())

    n = len(x)
    pairs, tx, ty = n * (n - 1) // 2, *((tied(x), tied(y)) if n else (0, 0))
    if pairs == tx or pairs == ty:
        return 0.0
    # by x, ties by y: what is out of order in y then is what the two orders disagree on
    ranks = np.unique(y, return_inverse=True)[1][np.lexsort((y, x))]
    against = 0
    for bit in reversed(range(int(ranks.max()).bit_length())):
        # values that agree in all higher bits stand together, in their order: count ones before zeros
        group, one = ranks >> (bit + 1), (ranks >> bit) & 1
        ones = np.cumsum(one) - one
        start = np.flatnonzero(np.diff(group, prepend=-1))
        before = ones - np.repeat(ones[start], np.diff(np.append(start, n)))
        against += int(before[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    agree = pairs - tx - ty + tied(x, y) - against
    return (agree - against) / math.sqrt((pairs - tx) * (pairs - ty))


@F.pandas_udf(T.DoubleType())
def tau_b(x: pd.Series, y: pd.Series) -> pd.Series:
    """Tau-b of two lists of numbers; NULL where a list is NULL or they differ in length."""
    side = lambda v: None if v is None else np.asarray(v, float)
    return pd.Series([None if (a := side(p)) is None or (b := side(q)) is None or len(a) != len(b) else tau_b_of(a, b) for p, q in zip(x, y, strict=True)], dtype="float64")
