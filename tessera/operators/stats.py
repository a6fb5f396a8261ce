"""Aggregates over columns. All skip nulls; frames are expected free of NaN."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import errors
from ..functions.ranking import cumulative, ordered_bucket
from ..storage import Workspace
from .selection import inversions, quantile_values

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "var": F.var_samp,
    "std": F.stddev_samp,
    "var_pop": F.var_pop,
    "std_pop": F.stddev_pop,
    "cv": lambda c: F.try_divide(F.stddev_samp(c), F.avg(c)),
    "median": F.median,
    "nunique": F.count_distinct,
    "nulls": lambda c: F.count_if(c.isNull()),
}


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def aggregate(df: DataFrame, columns: Sequence[str], functions: str | Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All functions of all columns in one pass."""
    names = [functions] if isinstance(functions, str) else list(functions)
    if unknown := set(names) - set(AGGREGATES):
        raise errors.InvalidArgumentError(f"unknown aggregates {sorted(unknown)}")
    one = isinstance(functions, str)
    made = [AGGREGATES[f](column(c)).alias(c if one else f"{c}_{f}") for c in columns for f in names]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def aggregate_python(df: DataFrame, columns: Sequence[str], functions: Callable | Sequence[Callable], by: Sequence[str] = (), kind: str = "double", most: int = 1_000_000) -> DataFrame:
    """Python functions of a Series, nulls as NaN; each group is held by one task, so it may have ``most`` rows at most."""
    made, one = [functions] if callable(functions) else list(functions), callable(functions)
    largest = df.groupBy(*[column(b) for b in by]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise errors.InvalidArgumentError(f"a Python aggregate takes groups of {most} rows at most, there is one of {largest}: use a named aggregate, or raise most")
    if not by and not largest:
        nothing = lambda name: F.max(F.lit(None).cast(kind)).alias(name)
        return df.agg(*[nothing(c if one else f"{c}_{f.__name__}") for c in columns for f in made])

    def udf(function: Callable):
        def over(values):
            return function(values)

        over.__annotations__ = {"values": pd.Series, "return": float}
        return F.pandas_udf(over, kind)

    found = [udf(f)(column(c)).alias(c if one else f"{c}_{f.__name__}") for c in columns for f in made]
    return df.groupBy(*[column(b) for b in by]).agg(*found) if by else df.agg(*found)


def idxmax(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key of each column's first maximum in key order."""
    best = []
    for c in columns:
        top = F.max(F.struct(column(c)))  # nulls are least in a struct
        best.append(top[c].alias(c))
    top = df.agg(*best)
    names = {c: f"__top{i}" for i, c in enumerate(columns)}
    joined = df.crossJoin(F.broadcast(top.withColumnsRenamed(names)))
    return joined.agg(*[F.min(F.when(column(c) == F.col(names[c]), column(key))).alias(c) for c in columns])


def quantiles(df: DataFrame, columns: Sequence[str], q: float | Sequence[float], exact: bool = True) -> DataFrame:
    """Linear interpolation between order statistics; approximate ones from a bounded sketch. One row per q, column ``q``.

    Exact ones are selected by counting buckets, which reads the table a few times; nothing holds
    the distinct values.
    """
    qs = [q] if isinstance(q, (int, float)) else list(q)
    if any(not 0 <= x <= 1 for x in qs):
        raise errors.InvalidArgumentError("quantiles lie between 0 and 1")
    if exact:
        found = quantile_values(df, columns, qs)
        rows = [(float(x), *[None if found[c][i] is None else float(found[c][i]) for c in columns]) for i, x in enumerate(qs)]
        return df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` double" for c in ["q", *columns]))
    lists = F.array(*[F.lit(float(x)) for x in qs])
    found = df.agg(*[F.percentile_approx(column(c).cast("double"), lists, 10_000).alias(c) for c in columns])
    zipped = F.explode(F.arrays_zip(lists.alias("q"), *[column(c).alias(c) for c in columns])).alias("z")
    return found.select(zipped).select(*[F.col(f"z.`{c}`").alias(c) for c in ["q", *columns]])


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, over rows that have both; null (no error) for a constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b)))


def slope(y: Column, x: Column) -> Column:
    """Least squares, over rows that have both; null (no error) for a constant x."""
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)))


def pairwise(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """column_a, column_b, value for every ordered pair; one aggregate over the table.

    cov (sample), pearson, spearman (of average ranks) or kendall (tau-b, from inversions).
    """
    if method == "spearman":
        ranked = df
        for c in columns:
            ranked = average_rank(ranked, c, f"__rank_{c}")
        df = ranked.select(*[column(f"__rank_{c}").alias(c) for c in columns])
        method = "pearson"
    if method == "kendall":
        return _kendall(df, columns)
    functions = {"cov": F.covar_samp, "pearson": correlation}
    if method not in functions:
        raise errors.InvalidArgumentError(f"unknown method {method!r}")
    pairs = list(itertools.combinations_with_replacement(columns, 2))
    row = df.agg(*[functions[method](column(a).cast("double"), column(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"p{i}").alias("value")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def average_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """Ranks from 1, ties averaged, nulls unranked; counted over distinct values."""
    counts = df.filter(column(c).isNotNull()).groupBy(column(c).alias("__v")).agg(F.count("*").alias("__c"))
    ranks = cumulative(counts, [], "__v", ["__c"]).select("__v", (F.col("__c__upto") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, column(c) == F.col("__v"), "left").drop("__v")


def _kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """tau-b from the inversions of distinct (x, y) cells and the ties of either column."""
    ws = Workspace(df.sparkSession, "kendall")
    rows = []
    for a, b in itertools.combinations_with_replacement(columns, 2):
        present = df.filter(column(a).isNotNull() & column(b).isNotNull())
        cells = ws.save(present.groupBy(column(a).cast("double").alias("x"), column(b).cast("double").alias("y")).agg(F.count("*").cast("double").alias("c")), "cells")
        pairs = F.col("c") * (F.col("c") - 1) / 2
        n, both = cells.agg(F.coalesce(F.sum("c"), F.lit(0.0)), F.coalesce(F.sum(pairs), F.lit(0.0))).first()
        tx, ty = (cells.groupBy(k).agg(F.sum("c").alias("c")).agg(F.coalesce(F.sum(pairs), F.lit(0.0))).first()[0] for k in ("x", "y"))
        total = n * (n - 1) / 2
        against = inversions(cells, ws) if a != b else 0.0
        scale = ((total - tx) * (total - ty)) ** 0.5
        value = (total - tx - ty + both - 2 * against) / scale if scale else None
        rows += [(p, q, value) for p, q in sorted({(a, b), (b, a)})]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, value double")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n: all most frequent values of each column, as text."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), column(c).cast("string").alias("value")) for c in columns])).alias("c")
    counts = df.select(cells).select("c.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy(F.col("column").alias("__column")).agg(F.max("n").alias("__n"))
    return counts.join(F.broadcast(top), (F.col("column") == F.col("__column")) & (F.col("n") == F.col("__n"))).select("column", "value", "n")


def value_counts(df: DataFrame, columns: Sequence[str], normalize: bool = False, dropna: bool = True, sort: bool = True, ascending: bool = False) -> DataFrame:
    """Rows for each combination of values; without ``sort`` in no order, which saves a shuffle."""
    df = df.dropna(subset=list(columns)) if dropna else df
    found, by = df.groupBy(*[column(c) for c in columns]).agg(F.count("*").alias("count")), "count"
    if normalize:
        total = df.agg(F.count("*").alias("__n"))
        found, by = found.crossJoin(F.broadcast(total)).withColumn("proportion", F.col("count") / F.col("__n")).drop("__n", "count"), "proportion"
    return found.orderBy(F.asc(by) if ascending else F.desc(by), *[column(c) for c in columns]) if sort else found


def fill_neighbour(df: DataFrame, key: str, columns: Sequence[str], method: str, buckets: int = 1024) -> DataFrame:
    """ffill or bfill in the order of a numeric or temporal key, without one global window.

    Each bucket of keys carries its last (first) value on to the later (earlier) buckets.
    """
    forward = method == "ffill"
    value = column(key).cast("double")
    span = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    placed = df.crossJoin(F.broadcast(span)).withColumn("__bucket", F.when(value.isNotNull(), ordered_bucket(value, F.col("__lo"), F.col("__hi"), buckets))).drop("__lo", "__hi")
    pick = F.max_by if forward else F.min_by
    edges = placed.groupBy("__bucket").agg(*[pick(column(c), F.when(column(c).isNotNull(), column(key))).alias(f"__e{i}") for i, c in enumerate(columns)])
    whole = Window.partitionBy(F.lit(0)).orderBy(F.col("__bucket").asc() if forward else F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(F.col("__bucket").alias("__b"), *[F.last(f"__e{i}", ignorenulls=True).over(whole).alias(f"__e{i}") for i in range(len(columns))])
    inside = Window.partitionBy("__bucket").orderBy(column(key).asc() if forward else column(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(carried, F.col("__bucket").eqNullSafe(F.col("__b")), "left")
    filled = {c: F.coalesce(F.last(column(c), ignorenulls=True).over(inside), F.col(f"__e{i}")) for i, c in enumerate(columns)}
    return out.withColumns(filled).select(*[column(c) for c in df.columns])
