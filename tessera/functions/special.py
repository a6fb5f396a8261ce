"""Distribution functions, in plain Python for the few rows of result tables, and as pandas UDFs."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY, _EPS = 1e-300, 1e-16


def normal_two_sided(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b) by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + top / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * value


def upper_gamma(a: float, x: float) -> float:
    """Regularised Q(a, x): a series for small x, a continued fraction otherwise."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    value = d
    for i in range(1, 2000):
        top = -i * (i - a)
        b += 2
        d = top * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + top / c
        c = c if abs(c) > _TINY else _TINY
        value *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, dof: float) -> float:
    return upper_gamma(dof / 2, x / 2)


def kolmogorov_upper(x: float) -> float:
    """Limit distribution of the scaled two-sample Kolmogorov-Smirnov distance."""
    if x < 0.2:
        return 1.0
    if x < 1.0:  # the dual series converges fast for small x
        terms = (math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 20))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * sum(terms)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_exact(d: float, n1: float, n2: float) -> float:
    """P(D >= d) of the two-sample Kolmogorov-Smirnov distance, exactly.

    A random order of both samples is a lattice path from (0, 0) to (n1, n2); the distance reaches
    d if the path meets a point (i, j) with abs(i / n1 - j / n2) >= d. The share of such paths to a
    point follows from its two predecessors; points of one i + j are computed at once, and only
    those between the two lines. All terms are positive, so small values keep their digits.
    """
    n1, n2 = int(n1), int(n2)
    g = math.gcd(n1, n2)
    a, b = n1 // g, n2 // g
    h = round(d * a * n2)  # d in units of 1 / lcm(n1, n2)
    if h <= 0:
        return 1.0
    share = np.ones(n1 + 3)  # share[i + 1]: of paths to (i, k - i)
    share[1] = 0.0
    for k in range(1, n1 + n2 + 1):
        lo = max(0, k - n2, -((h - 1 - k * a) // (a + b)))
        hi = min(n1, k, (k * a + h - 1) // (a + b))
        if lo > hi:
            return 1.0
        i = np.arange(lo, hi + 1)
        share[lo + 1 : hi + 2] = (i * share[lo : hi + 1] + (k - i) * share[lo + 1 : hi + 2]) / k
        share[lo] = share[hi + 2] = 1.0
    return float(share[n1 + 1])


def u_exact(u: float, n1: float, n2: float) -> float:
    """min(1, 2 P(U >= u)) of the Mann-Whitney statistic without ties, u the larger of both sides' statistics.

    The frequencies of U are the coefficients of the Gaussian binomial of n1 + n2 and the smaller
    size, a product of (1 - q^(n + i)) / (1 - q^i).
    """
    m, n = sorted((int(n1), int(n2)))
    share = np.ones(1)
    for i in range(1, m + 1):
        made = np.zeros(n * i + 1)
        made[: len(share)] = share
        made[n + i :] -= share[: max(0, len(made) - n - i)]
        padded = np.zeros(-(-len(made) // i) * i)
        padded[: len(made)] = made
        share = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[: len(made)] * (i / (n + i))
    return float(min(1.0, 2 * np.sort(share[math.ceil(u) :]).sum())) if u <= m * n else 0.0


def _over(function: Callable[..., float]) -> Callable[..., Column]:
    def one(*values: float) -> float | None:
        return None if any(v is None or v != v or abs(v) == math.inf for v in values) else function(*values)

    def unary(a: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in a], dtype=float)

    def binary(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    def ternary(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([one(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype=float)

    def call(*columns: Column) -> Column:
        return F.pandas_udf((unary, binary, ternary)[len(columns) - 1], T.DoubleType())(*[c.cast("double") for c in columns])

    return call


#: The same as column functions; null in, null out.
normal_two_sided_column = _over(normal_two_sided)
t_two_sided_column = _over(t_two_sided)
chi2_upper_column = _over(chi2_upper)
kolmogorov_upper_column = _over(kolmogorov_upper)
ks_exact_column = _over(ks_exact)
u_exact_column = _over(u_exact)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.asarray(x, float)))
