"""Preprocessing: column filters (as reports and as steps on a RoleFrame), fillers and encoders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..frame import RoleFrame
from ..roles import NUMERIC, AdditionalFeatureRole, FeatureRole, TargetRole
from . import stats
from .selection import quantile_values
from .stats import column

Step = Callable[[RoleFrame], RoleFrame]


def cv_report(df: DataFrame, columns: Sequence[str], lower: float | None = None, upper: float | None = None) -> DataFrame:
    """column, statistic, keep: the coefficient of variation within its bounds."""
    cv = _report(df.agg(*[F.try_divide(F.stddev_samp(column(c)), F.avg(column(c))).alias(c) for c in columns]), columns)
    keep = F.lit(True)
    if lower is not None:
        keep &= F.coalesce(F.col("statistic") >= lower, F.lit(False))
    if upper is not None:
        keep &= F.coalesce(F.col("statistic") <= upper, F.lit(False))
    return cv.withColumn("keep", keep)


def nan_report(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """column, statistic (share of nulls), keep."""
    shares = df.agg(*[F.avg(column(c).isNull().cast("double")).alias(c) for c in columns])
    return _report(shares, columns).withColumn("keep", ~F.coalesce(F.col("statistic") > threshold, F.lit(False)))


def const_report(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """column, statistic (share of the most frequent value among non-null ones), keep."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), column(c).cast("string").alias("v")) for c in columns])).alias("c")
    counts = df.select(cells).select("c.*").filter("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    shares = counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("statistic"))
    return shares.withColumn("keep", F.col("statistic") <= threshold)


def corr_report(df: DataFrame, features: Sequence[str], others: Sequence[str] = (), threshold: float = 0.8, method: str = "pearson") -> DataFrame:
    """column, statistic (largest absolute correlation with a later feature or another column), keep.

    Of two correlated features the first goes.
    """
    names = [*features, *others]
    matrix = stats.pairwise(df, names, method)
    place = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))])
    later = matrix.filter(F.col("column_a").isin(list(features)) & (place[F.col("column_b")] > place[F.col("column_a")]))
    top = later.groupBy(F.col("column_a").alias("column")).agg(F.max(F.abs("value")).alias("statistic"))
    every = df.sparkSession.createDataFrame([(c,) for c in features], "column string")
    return every.join(top, "column", "left").withColumn("keep", ~F.coalesce(F.col("statistic") > threshold, F.lit(False)))


def _report(row: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), column(c).alias("statistic")) for c in columns])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def _demoting(report: Callable[[RoleFrame, list[str]], DataFrame], columns_of: Callable[[RoleFrame], list[str]]) -> Step:
    def step(frame: RoleFrame) -> RoleFrame:
        columns = columns_of(frame)
        if not columns:
            return frame
        gone = [r["column"] for r in report(frame, columns).filter(~F.col("keep")).collect()]  # one row a column
        return frame.demote(gone)

    return step


def _features(frame: RoleFrame) -> list[str]:
    return frame.search_columns(FeatureRole)


def _numeric_features(frame: RoleFrame) -> list[str]:
    return frame.search_columns(FeatureRole, NUMERIC)


def cv_filter(lower: float | None = None, upper: float | None = None) -> Step:
    return _demoting(lambda f, c: cv_report(f.df, c, lower, upper), _numeric_features)


def const_filter(threshold: float = 0.95) -> Step:
    return _demoting(lambda f, c: const_report(f.df, c, threshold), _features)


def nan_filter(threshold: float = 0.8) -> Step:
    return _demoting(lambda f, c: nan_report(f.df, c, threshold), _features)


def corr_filter(threshold: float = 0.8, method: str = "pearson") -> Step:
    return _demoting(lambda f, c: corr_report(f.df, c, f.search_columns(TargetRole, NUMERIC), threshold, method), _numeric_features)


def drop_outliers(df: DataFrame, columns: Sequence[str], lower: float = 0.05, upper: float = 0.95, exact: bool = True) -> DataFrame:
    """Rows whose columns all lie between the quantiles; nulls do not count as outliers."""
    if exact:
        found = quantile_values(df, columns, [lower, upper])
        bounds = [[F.lit(v) for v in found[c]] for c in columns]
        joined = df
    else:
        both = F.array(F.lit(lower), F.lit(upper))
        sketch = df.agg(*[F.percentile_approx(column(c).cast("double"), both, 10_000).alias(f"__q{i}") for i, c in enumerate(columns)])
        joined = df.crossJoin(F.broadcast(sketch))  # one row
        bounds = [[F.col(f"__q{i}")[0], F.col(f"__q{i}")[1]] for i in range(len(columns))]
    inside = reduce(lambda a, b: a & b, (F.coalesce((column(c) >= lo) & (column(c) <= hi), F.lit(True)) for c, (lo, hi) in zip(columns, bounds, strict=True)))
    return joined.filter(inside).select(*[column(c) for c in df.columns])


def outliers_filter(lower: float = 0.05, upper: float = 0.95, exact: bool = True) -> Step:
    return lambda f: f.new(drop_outliers(f.df, c, lower, upper, exact)) if (c := _numeric_features(f)) else f


def aggregate_categories(df: DataFrame, columns: Sequence[str], threshold: int = 15, new_name: str | None = None) -> DataFrame:
    """Categories with fewer rows than ``threshold`` become ``new_name``. Counts are joined, not windowed."""
    for i, c in enumerate(columns):
        rare = df.groupBy(column(c).alias(f"__v{i}")).agg(F.count("*").alias("__n")).filter(F.col("__n") < threshold).select(f"__v{i}", F.lit(True).alias(f"__rare{i}"))
        df = df.join(rare, column(c) == F.col(f"__v{i}"), "left").withColumn(c, F.when(F.col(f"__rare{i}"), F.lit(new_name)).otherwise(column(c))).drop(f"__v{i}", f"__rare{i}")
    return df


def category_aggregator(threshold: int = 15, new_name: str | None = None) -> Step:
    return lambda f: f.new(aggregate_categories(f.df, f.search_columns(FeatureRole, [str]), threshold, new_name))


def na_filler(values: Any = None, method: str | None = None) -> Step:
    def step(frame: RoleFrame) -> RoleFrame:
        columns = _features(frame)
        if not columns:
            return frame
        if method is None:
            return frame.fillna({c: values for c in columns} if not isinstance(values, Mapping) else values)
        return frame.new(stats.fill_neighbour(frame.df, frame._order(), columns, method))

    return step


def type_caster(types: Mapping) -> Step:
    """By column name, or by present type ({int: float})."""

    def step(frame: RoleFrame) -> RoleFrame:
        wanted = {c: t for k, t in types.items() for c in ([k] if isinstance(k, str) else frame.search_columns_by_type(k))}
        return frame.astype(wanted)

    return step


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """0/1 columns <column>_<value> for the sorted values, without the first; null is all zeros.

    A column may have ``most`` values; pool rare ones with ``aggregate_categories`` first.
    """
    made: dict[str, Any] = {}
    for c in columns:
        values = sorted(r[0] for r in df.select(column(c)).filter(column(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise errors.NotSuitableFieldError(f"{c} has more than {most} values, too many for a column each: pool rare ones first, or raise most")
        for v in values[1:] if drop_first else values:
            made[f"{c}_{v}"] = F.coalesce((column(c) == F.lit(v)).cast("int"), F.lit(0))
    return (df.withColumns(made) if made else df), list(made)


def dummy_encoder() -> Step:
    def step(frame: RoleFrame) -> RoleFrame:
        df, made = one_hot(frame.df, frame.search_columns(FeatureRole, [str]))
        return frame.new(df, frame.roles | {c: AdditionalFeatureRole(int) for c in made})

    return step


def shuffle(seed: int = 0) -> Step:
    """Rows in a random order that depends on key and seed."""
    from ..functions.ranking import hash_order

    return lambda f: f.new(f.df.orderBy(hash_order(f._order(), seed)))


def pipeline(*steps: Step) -> Step:
    return lambda frame: reduce(lambda f, step: step(f), steps, frame)


def standard(new_name: str | None = "other") -> Step:
    """The usual order: fill, pool categories, filter columns, cut outliers, encode."""
    return pipeline(na_filler(method="ffill"), category_aggregator(new_name=new_name), corr_filter(), cv_filter(), nan_filter(), const_filter(), outliers_filter(), dummy_encoder())
