"""Sliding and session windows, and a sequential test whose state lives across batches.

All work on streams and on tables. Windows end at the watermark; rows later than it are left out, as
Structured Streaming does. The sequential test keeps sums alone, so late rows count like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n0", "m0", "s0", "n1", "m1", "s1")  # of control and test: rows, mean, sum of squared deviations
_STATE = "n0 double, m0 double, s0 double, n1 double, m1 double, s1 double, least double"
_OUT = "key string, n0 long, n1 long, difference double, likelihood_ratio double, p_value double, least_p double"


def _kept(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withWatermark(time, late) if events.isStreaming else events


def sliding_moments(events: DataFrame, group: Column, value: str, time: str = "ts", window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, group, n, mean, var for each window; windows overlap, so a row counts in window / slide of them."""
    out = _kept(events, time, late).groupBy(F.window(F.col(time), window, slide).alias("w"), group.alias("group")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    return out.select(F.col("w.start").alias("start"), "group", "n", "mean", "var")


def sessions(events: DataFrame, key: Column, value: str, time: str = "ts", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """key, start, end, n, total for each session: rows of a key whose neighbours are less than ``gap`` apart; it ends ``gap`` after its last row."""
    out = _kept(events, time, late).filter(key.isNotNull()).groupBy(F.session_window(F.col(time), gap).alias("w"), key.alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def likelihood_ratio(n0: Column, v0: Column, n1: Column, v1: Column, difference: Column, tau: float) -> Column:
    """Of a normal mixture of differences with deviation tau against none; one over it is a p-value at any time it is looked at."""
    v = v0 / n0 + v1 / n1
    return F.sqrt(F.try_divide(v, v + tau * tau)) * F.exp(F.try_divide(F.lit(tau * tau) * difference * difference, 2 * v * (v + tau * tau)))


def sequential_test(events: DataFrame, key: Column, test: Column, value: str, tau: float = 1.0) -> DataFrame:
    """key, n0, n1, difference, likelihood_ratio, p_value, least_p.

    ``test`` is true for the test arm, false for the control. On a stream a key gives a row for each batch
    that brings it rows (output mode update), and least_p is the least p-value of the batches so far,
    itself valid at any time; a table is one batch. Without two rows in each arm nothing is decided.
    """
    rows = events.select(key.cast("string").alias("key"), test.alias("test"), F.col(value).cast("double").alias("value")).filter("key is not null and test is not null and value is not null")
    if not rows.isStreaming:
        side = lambda t, f: f(F.when(F.col("test") if t else ~F.col("test"), F.col("value")))
        found = rows.groupBy("key").agg(*[side(t, f).alias(f"{n}{int(t)}") for t in (False, True) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
        found = found.withColumn("difference", F.col("m1") - F.col("m0"))
        ratio = likelihood_ratio(F.col("n0"), F.col("v0"), F.col("n1"), F.col("v1"), F.col("difference"), tau)
        ratio = F.when((F.col("n0") > 1) & (F.col("n1") > 1), ratio)
        p = F.least(F.lit(1.0), F.try_divide(F.lit(1.0), ratio))
        return found.withColumns({"likelihood_ratio": ratio, "p_value": p, "least_p": p}).select("key", "n0", "n1", "difference", "likelihood_ratio", "p_value", "least_p")

    def step(own: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0.0] * 6 + [1.0]
        for rows in batches:
            for t in (0, 1):
                new = rows.loc[rows["test"] == bool(t), "value"].to_numpy(float)
                if len(new):
                    n, m, s = held[3 * t : 3 * t + 3]
                    gap, total = new.mean() - m, n + len(new)
                    held[3 * t : 3 * t + 3] = [total, m + gap * len(new) / total, s + ((new - new.mean()) ** 2).sum() + gap * gap * n * len(new) / total]
        n0, m0, s0, n1, m1, s1, least = held
        difference = m1 - m0 if n0 and n1 else None
        ratio = p = None
        if n0 > 1 and n1 > 1:
            v = s0 / (n0 - 1) / n0 + s1 / (n1 - 1) / n1
            if v > 0:
                ratio = float(np.sqrt(v / (v + tau * tau)) * np.exp(min(700.0, tau * tau * difference * difference / (2 * v * (v + tau * tau)))))
                p = min(1.0, 1 / ratio)
                held[6] = least = min(least, p)
        state.update(tuple(float(x) for x in held))
        yield pd.DataFrame({"key": [own[0]], "n0": [int(n0)], "n1": [int(n1)], "difference": [difference], "likelihood_ratio": [ratio], "p_value": [p], "least_p": [least if p is not None else None]}).astype({"difference": float, "likelihood_ratio": float, "p_value": float, "least_p": float})

    return rows.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "update", "NoTimeout")
