"""Corrections for several hypotheses, best-arm selection and sample sizes.

The inputs are result tables: one row per hypothesis, or moments per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions.special import normal_quantile
from .stats import column

METHODS = ("bonferroni", "sidak", "holm-sidak", "holm", "simes-hochberg", "hommel", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")


def _step_up(p: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Running minimum from the largest p."""
    return np.minimum.accumulate((p * factor)[::-1])[::-1]


def adjust(p_values: Sequence[float], method: str, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(adjusted p-values, rejected); missing p-values stay missing and are no hypotheses."""
    values = np.array([np.nan if v is None else v for v in p_values], float)
    known = np.flatnonzero(~np.isnan(values))
    order = known[np.argsort(values[known], kind="stable")]
    p, m = values[order], len(order)
    if method not in METHODS:
        raise errors.InvalidArgumentError(f"method {method!r}; one of {METHODS}")
    i = np.arange(1, m + 1)
    reject = None
    if not m:
        new = p
    elif method == "bonferroni":
        new = p * m
    elif method == "sidak":
        new = -np.expm1(m * np.log1p(-np.minimum(p, 1 - 1e-16)))
    elif method == "holm":
        new = np.maximum.accumulate(p * (m - i + 1))
    elif method == "holm-sidak":
        new = np.maximum.accumulate(-np.expm1((m - i + 1) * np.log1p(-np.minimum(p, 1 - 1e-16))))
    elif method == "simes-hochberg":
        new = _step_up(p, m - i + 1.0)
    elif method == "fdr_bh":
        new = _step_up(p, m / i)
    elif method == "fdr_by":
        new = _step_up(p, m / i * (1 / i).sum())
    elif method == "hommel":
        new = p.copy()
        for j in range(m, 1, -1):
            tail = np.arange(m - j, m)  # the j largest
            c = (j * p[tail] / np.arange(1, j + 1)).min()
            new[tail] = np.maximum(new[tail], c)
            head = np.arange(0, m - j)
            new[head] = np.maximum(new[head], np.minimum(c, j * p[head]))
    else:  # two-stage: the first pass estimates the true null hypotheses
        level = alpha / (1 + alpha) if method == "fdr_tsbky" else alpha
        first = _step_up(p, m / i)
        found = int((first <= level).sum())
        left = m - found
        scale = (1 + alpha) if method == "fdr_tsbky" else 1.0
        new = first * scale if left in (0, m) else first * left / m * scale
        reject = new <= alpha
    new = np.minimum(new, 1.0)
    reject = new <= alpha if reject is None else reject
    out, rejected = np.full(len(values), np.nan), np.zeros(len(values), bool)
    out[order], rejected[order] = new, reject
    return out, rejected


def multitest(results: DataFrame, method: str, alpha: float = 0.05, by: Sequence[str] = (), p: str = "p_value") -> DataFrame:
    """Adds new_p_value, correction (old / new, 0 if old is 0) and rejected, for each family ``by``."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        new, rejected = adjust(frame[p], method, alpha)
        old = frame[p].to_numpy(float)
        correction = np.where(old == 0, 0.0, np.divide(old, new, out=np.full(len(old), np.nan), where=new > 0))
        return frame.assign(new_p_value=new, correction=correction, rejected=rejected)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema.fields)
    keys = [column(b) for b in by] or [F.lit(0).alias("__family")]
    return results.groupBy(*keys).applyInPandas(work, f"{schema}, new_p_value double, correction double, rejected boolean")


GRID = np.arange(-9, 9.0001, 0.005)
_erfc = np.vectorize(math.erfc, otypes=[float])


def minimal_t_above(var: np.ndarray, j: int, t: float, shift: float = 0.0) -> float:
    """P(min over i of the scaled difference of arm j and arm i > t), arm j's mean being ``shift`` larger.

    Given arm j's own value the other arms are independent, so this is one integral over its normal.
    """
    others = np.delete(var, j)
    limits = (GRID[:, None] * math.sqrt(var[j]) + shift - t * np.sqrt(var[j] + others)[None, :]) / np.sqrt(others)[None, :]
    below = (_erfc(-limits / math.sqrt(2)) / 2).prod(axis=1)
    return float((below * np.exp(-GRID * GRID / 2)).sum() * (GRID[1] - GRID[0]) / math.sqrt(2 * math.pi))


def minimal_t_quantile(var: np.ndarray, j: int, level: float, iterations: int | None = None, random: np.random.Generator | None = None) -> float:
    """Quantile of min over i of the scaled difference of arm j and arm i when all means are equal; simulated if ``iterations`` is given."""
    if iterations:
        draws = random.normal(0, np.sqrt(var), (iterations, len(var)))
        gaps = [(draws[:, j] - draws[:, i]) / math.sqrt(var[j] + var[i]) for i in range(len(var)) if i != j]
        return float(np.quantile(np.min(gaps, axis=0), level))
    lo, hi = -9.0, 9.0
    for _ in range(50):
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if 1 - minimal_t_above(var, j, middle) < level else (lo, middle)
    return lo


def best_arm(moments: pd.DataFrame, alpha: float = 0.05, iterations: int | None = None, equal_variance: bool = True, seed: int = 42, size: str = "total") -> int:
    """Rows n, mean, var of each arm: the number (from 1) of the first arm better than all others, or 0.

    Differences are scaled by the arms' own variances; ``equal_variance`` concerns the quantile
    they must exceed. ``size`` is the number of rows that scales them: all of them
    ("total", variances then times n / (n - 1)), or those of the smallest arm ("least"). The
    quantile is an integral; with ``iterations`` it is simulated.
    """
    if size not in ("total", "least"):
        raise errors.InvalidArgumentError(f"size {size!r}: total or least")
    n, mean, var = (moments[c].to_numpy(float) for c in ("n", "mean", "var"))
    random = np.random.default_rng(seed)
    rows = n.sum() if size == "total" else n.min()
    scale = var * rows / (rows - 1) if size == "total" else var
    level = 1 - alpha / len(n)
    common = minimal_t_quantile(np.ones(len(n)), 0, level, iterations, random) if equal_variance else None
    for j in range(len(n)):
        least = min(math.sqrt(rows) * (mean[j] - mean[i]) / math.sqrt(scale[j] + scale[i]) for i in range(len(n)) if i != j)
        if least > (common if equal_variance else minimal_t_quantile(scale, j, level, iterations, random)):
            return j + 1
    return 0


def arm_moments(df: DataFrame, group: str, target: str) -> pd.DataFrame:
    """n, mean and var of each group, in order: as many rows as groups."""
    found = df.filter(column(group).isNotNull()).groupBy(column(group).alias("g")).agg(F.count(column(target)).alias("n"), F.avg(column(target)).alias("mean"), F.var_samp(column(target)).alias("var"))
    return found.orderBy("g").toPandas()


def best_group(df: DataFrame, group: str, targets: Sequence[str], alpha: float = 0.05, **options) -> dict[str, int]:
    return {t: best_arm(arm_moments(df, group, t), alpha, **options) for t in targets}


def min_sample_size(variances: Sequence[float], mde: float, power: float = 0.2, alpha: float = 0.05, equal_variance: bool = True, most: int = 10_000_000) -> int:
    """Rows a group needs to find ``mde``; ``power`` is the error of the second kind.

    Equal variances: from two quantiles of the minimal statistic. Otherwise the least size, up to
    ``most``, at which the first arm, better by ``mde``, is found with probability 1 - power.
    """
    var = np.array(variances, float)
    k = len(var)
    if equal_variance:
        q1, q2 = (minimal_t_quantile(np.ones(k), 0, level) for level in (1 - alpha / k, power))
        return int(2 * var.mean() * ((q1 - q2) / mde) ** 2) + 1
    q1 = minimal_t_quantile(var, 0, 1 - alpha / k)
    lo, hi = 0, most
    while hi - lo > 1:
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if minimal_t_above(var, 0, q1, math.sqrt(middle) * mde) >= 1 - power else (middle, hi)
    return hi


def min_sample_sizes(df: DataFrame, group: str, targets: Sequence[str], mde: float, **options) -> dict[str, int]:
    """By target, and the largest as ``overall``."""
    found = {t: min_sample_size(arm_moments(df, group, t)["var"], mde, **options) for t in targets}
    return found | {"overall": max(found.values())}


def two_sample_size(variance: float, mde: float, significance: float = 0.95, power: float = 0.8) -> int:
    """The textbook size of each of two groups."""
    z = normal_quantile((1 + significance) / 2) + normal_quantile(power)
    return int(2 * variance * (z / mde) ** 2) + 1
