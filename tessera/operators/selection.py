"""Order statistics and inversions without holding a column in one task.

``order_statistics`` counts rows by ordered buckets, reads only the bucket that holds each wanted
rank again, and so on until a bucket has few rows. ``inversions`` counts pairs that two columns
order differently: by prefix between buckets (the same question about far fewer cells), within
one bucket in memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import cumulative, ordered_bucket
from ..storage import Workspace

FEW = 20_000  # rows of a bucket whose values are read
BUCKET = 200_000  # cells that are compared in memory; a bucket has twice as many at most


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class _Part:
    """Values of a column between lo and hi: ``n`` of them, ``before`` smaller ones."""

    column: str
    lo: float
    hi: float
    n: int
    before: int


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]], spans: dict[str, tuple[float, float, int]]) -> dict[str, dict[int, float]]:
    """The values at the wanted ranks (from 0) of each column; spans: least, greatest and number of values.

    Every round reads the table once for all columns and ranks; a round's result has as many rows
    as there are buckets. The ends of a part fall into different buckets, so each round leaves
    fewer distinct values.
    """
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    parts = {(c, r): _Part(c, *spans[c], 0) for c, ranks in wanted.items() for r in ranks}
    while True:
        for key, p in list(parts.items()):
            if p.lo == p.hi:
                found[p.column][key[1]] = p.lo
                del parts[key]
        if not parts:
            return found
        distinct = list(dict.fromkeys(parts.values()))

        def inside(p: _Part) -> Column:
            v = _column(p.column).cast("double")
            return v.between(p.lo, p.hi)

        def cell(i: int, p: _Part) -> Column:
            v = _column(p.column).cast("double")
            none = F.lit(None).cast("bigint")
            few = F.struct(none.alias("a"), none.alias("b"), none.alias("c"), none.alias("d"))
            bucket = few if p.n <= FEW else ordered_bucket(v, F.lit(p.lo), F.lit(p.hi))
            return F.when(inside(p), F.struct(F.lit(i).alias("part"), bucket.alias("bucket"), F.when(F.lit(p.n <= FEW), v).alias("value"), v.alias("v")))

        rows = df.select(F.explode(F.array_compact(F.array(*[cell(i, p) for i, p in enumerate(distinct)]))).alias("o")).select("o.*")
        counts = rows.groupBy("part", "bucket", "value").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).drop("bucket", "value").toPandas()
        told = {}
        for i, own in counts.groupby("part"):
            own = own.sort_values("lo", kind="stable")
            told[distinct[i]] = (own["lo"].to_numpy(), own["hi"].to_numpy(), own["n"].to_numpy(), np.cumsum(own["n"].to_numpy()))
        for key, p in list(parts.items()):
            lo, hi, n, upto = told[p]
            at = int(np.searchsorted(upto, key[1] - p.before, side="right"))
            parts[key] = replace(p, lo=float(lo[at]), hi=float(hi[at]), n=int(n[at]), before=p.before + int(upto[at] - n[at]))


def quantile_values(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear interpolation between order statistics, for each column and q; None for a column without values."""
    at = [(F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.count(v).alias(f"n{i}")) for i, c in enumerate(columns) for v in [_column(c).cast("double")]]
    row = df.agg(*[a for x in at for a in x]).first()
    spans = {c: (row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]) for i, c in enumerate(columns) if row[f"n{i}"]}
    place = {c: [(n - 1) * q for q in qs] for c, (_, _, n) in spans.items()}
    found = order_statistics(df, {c: sorted({int(np.floor(p)) for p in x} | {int(np.ceil(p)) for p in x}) for c, x in place.items()}, spans)
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in columns}
    for c, places in place.items():
        low = [found[c][int(np.floor(p))] for p in places]
        high = [found[c][int(np.ceil(p))] for p in places]
        out[c] = [a if a == b else (np.ceil(p) - p) * a + (p - np.floor(p)) * b for a, b, p in zip(low, high, places, strict=True)]
    return out


def count_inversions(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Weight of pairs with x[i] < x[j] and y[i] > y[j]; equal ones do not count.

    One bit of the rank of y at a time: of values that agree in all higher bits, those with the bit
    set are greater than those without.
    """
    order = np.argsort(x, kind="stable")
    _, xr = np.unique(x[order], return_inverse=True)
    _, yr = np.unique(y[order], return_inverse=True)
    w = c[order].astype(float)
    total = 0.0
    for bit in range(int(yr.max(initial=0)).bit_length()):
        by = np.argsort(yr >> (bit + 1), kind="stable")
        group, own, high, weight = (yr >> (bit + 1))[by], xr[by], ((yr >> bit) & 1)[by], w[by]
        upto = np.concatenate([[0.0], np.cumsum(weight * high)])
        fresh = np.r_[True, group[1:] != group[:-1]]
        tied = np.r_[True, (own[1:] != own[:-1]) | fresh[1:]]
        index = np.arange(len(by))
        start = np.maximum.accumulate(np.where(fresh, index, 0))
        first = np.maximum.accumulate(np.where(tied, index, 0))
        total += float(((upto[first] - upto[start]) * weight * (1 - high)).sum())
    return total


def _inversions_of(x: str, y: str):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [count_inversions(rows[x].to_numpy(), rows[y].to_numpy(), rows["c"].to_numpy())]})

    return work


def inversions(cells: DataFrame, ws: Workspace, bucket: int = BUCKET) -> float:
    """Weight of pairs of cells (x, y, c: double) with x < x' and y > y'.

    Cells are dealt to ordered buckets of x and of y; a value with more cells than a bucket has one
    of its own, where nothing is to compare. Pairs of one x bucket, and pairs of one y bucket
    from different x buckets, are counted in memory; all others differ in both buckets, so buckets
    take the place of the values and equal cells are put together.
    """
    n = cells.count()
    if n <= bucket:
        return cells.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_inversions_of("x", "y"), "d double").agg(F.sum("d")).first()[0] or 0.0
    placed = cells
    for k in ("x", "y"):
        sizes = cumulative(cells.groupBy(k).agg(F.count("*").cast("double").alias("n")), [], k, ["n"])
        before = F.col("n__upto") - F.col("n")
        own = F.floor(before / bucket) * 2 + (F.col("n") > bucket).cast("int")
        placed = placed.join(sizes.select(k, own.cast("double").alias(f"{k}b")), k)
    placed = ws.save(placed.select("x", "y", "xb", "yb", "c"), "cells")
    total = 0.0
    for key, x in (("xb", "x"), ("yb", "xb")):
        shared = placed.filter(F.col(key) % 2 == 0).groupBy(key).applyInPandas(_inversions_of(x, "y"), "d double")
        total += shared.agg(F.sum("d")).first()[0] or 0.0
    coarse = ws.save(placed.groupBy(F.col("xb").alias("x"), F.col("yb").alias("y")).agg(F.sum("c").alias("c")), "coarse")
    return total + inversions(coarse, ws, bucket if coarse.count() * 2 <= n else bucket * 4)
