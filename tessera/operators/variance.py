"""Variance reduction: CUPED with one covariate, CUPAC with a model of the target's past.

CUPAC's linear models are fitted and cross-validated from the moments of each fold, one aggregate
over the training rows; a held-out fold's remaining variance follows from its moments too. Text
covariates become ordered target statistics: a training row's category stands for the mean target of
the rows of that category that come before it in a random order, so it never sees its own target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..functions.ranking import hash_prefix_sums
from ..storage import Workspace
from .stats import column, slope

LINEAR = ("linear", "ridge", "lasso")


def _theta(y: str, x: str, kind: str):
    a, b = column(y).cast("double"), column(x).cast("double")
    if kind == "ols":
        return F.coalesce(slope(a, b), F.lit(0.0))
    if kind == "reference":  # the covariance over both deviations
        return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_samp(a) * F.stddev_samp(b)), F.lit(0.0))
    raise errors.InvalidArgumentError(f"theta {kind!r}: ols or reference")


def cuped(df: DataFrame, covariates: Mapping[str, str], theta: str = "ols") -> DataFrame:
    """Adds <target>_cuped = y - theta (x - mean x) for each {target: covariate}; theta is fitted in one aggregate."""
    parts = [e for i, (y, x) in enumerate(covariates.items()) for e in (_theta(y, x, theta).alias(f"__theta{i}"), F.avg(column(x)).alias(f"__mean{i}"))]
    joined = df.crossJoin(F.broadcast(df.agg(*parts)))
    made = {f"{y}_cuped": column(y) - F.col(f"__theta{i}") * (column(x) - F.col(f"__mean{i}")) for i, (y, x) in enumerate(covariates.items())}
    return joined.withColumns(made).select(*[column(c) for c in df.columns if c not in made], *[column(c) for c in made])


def variance_reduction(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """target, reduction_pct = (1 - var(adjusted) / var(target)) * 100 for each {target: adjusted}."""
    cells = [F.struct(F.lit(y).alias("target"), ((1 - F.try_divide(F.var_samp(column(a)), F.var_samp(column(y)))) * 100).alias("reduction_pct")) for y, a in pairs.items()]
    return df.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@dataclass(frozen=True)
class CupacPlan:
    """One target: its lags, newest first, and for each lag period the covariates of that period.

    covariates[k] belong to period k + 1 before the present; they and lag k + 1 predict lag k.
    Covariates are numbers or texts, the same kind in every period.
    """

    target: str
    lags: tuple[str, ...]
    covariates: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class CupacReport:
    target: str
    model: str
    reduction_pct: dict[str, float]
    importances: dict[str, float]


@dataclass(frozen=True)
class Moments:
    """Count, means and covariances (population) of the inputs and, last, the target."""

    n: float
    mean: np.ndarray
    cov: np.ndarray

    @staticmethod
    def together(parts: Sequence[Moments]) -> Moments:
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / max(n, 1)
        return Moments(n, mean, sum(p.n * (p.cov + np.outer(p.mean - mean, p.mean - mean)) for p in parts) / max(n, 1))

    def left_over(self, slopes: np.ndarray) -> float:
        """Variance of the target less a linear function of the inputs."""
        return float(self.cov[-1, -1] - 2 * slopes @ self.cov[:-1, -1] + slopes @ self.cov[:-1, :-1] @ slopes)


def fold_moments(rows: DataFrame, names: Sequence[str], fold: str) -> dict[int, Moments]:
    """Moments of the columns in each fold, from one aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    found = rows.groupBy(fold).agg(F.count("*").alias("n"), F.array(*[F.avg(n) for n in names]).alias("mean"), F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("cov")).collect()  # as many rows as folds
    out = {}
    for r in found:
        cov = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, r["cov"], strict=True):
            cov[i, j] = cov[j, i] = v
        out[r[fold]] = Moments(float(r["n"]), np.array(r["mean"], float), cov)
    return out


def linear_slopes(model: str, m: Moments, penalty: float = 1.0, rounds: int = 10_000) -> np.ndarray:
    """Least squares; with penalty times the squared slopes (ridge); with half the mean squared error plus penalty times their sizes (lasso)."""
    gram, cross = m.cov[:-1, :-1], m.cov[:-1, -1]
    if model == "linear":
        return np.linalg.lstsq(gram, cross, rcond=None)[0]
    if model == "ridge":
        return np.linalg.solve(m.n * gram + penalty * np.eye(len(gram)), m.n * cross)
    slopes = np.zeros(len(gram))
    for _ in range(rounds):  # one slope at a time
        before = slopes.copy()
        for j in range(len(slopes)):
            if gram[j, j] > 0:
                rest = cross[j] - gram[j] @ slopes + gram[j, j] * slopes[j]
                slopes[j] = np.sign(rest) * max(abs(rest) - penalty, 0) / gram[j, j]
        if np.abs(slopes - before).max(initial=0) <= 1e-12 * max(1.0, np.abs(slopes).max(initial=0)):
            break
    return slopes


def _reduction(v: float, left: float) -> float:
    return 0.0 if v < 1e-10 else max(0.0, (1 - left / v) * 100)


def target_statistics(rows: DataFrame, key: str, text: Sequence[str], target: str, names: Sequence[str], prior: float = 1.0) -> tuple[DataFrame, list[DataFrame], float]:
    """Adds ``names``: for each text column the mean target of the earlier rows of its category, the overall mean weighing as ``prior`` rows.

    Also the categories' own tables (category, encoded) for rows to be predicted, and the overall
    mean. Rows are ordered by a hash of ``key``; sums before a row come from sums over hash
    prefixes, so a category that holds most rows is spread.
    """
    mean = rows.agg(F.avg(target)).first()[0] or 0.0
    tables = []
    for c, n in zip(text, names, strict=True):
        rows = hash_prefix_sums(rows.withColumn("__one", F.lit(1.0)), key, F.md5(F.concat(column(key).cast("string"), F.lit(":target"))), [c], [target, "__one"])
        rows = rows.withColumn(n, (F.col(f"{target}__earlier") + prior * mean) / (F.col("__one__earlier") + prior)).drop("__one", f"{target}__earlier", "__one__earlier")
        tables.append(rows.filter(column(c).isNotNull()).groupBy(column(c).alias("category")).agg(((F.sum(target) + prior * mean) / (F.count("*") + prior)).alias("encoded")))
    return rows, tables, mean


def _boosted(features: str = "__x", label: str = "__y"):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol=features, labelCol=label, predictionCol="__prediction", seed=42)


def cupac(df: DataFrame, plan: CupacPlan, key: str, models: Sequence[str] = LINEAR, folds: int = 5) -> tuple[DataFrame, CupacReport]:
    """Adds <target>_cupac = y - (prediction - mean prediction) by the model with the best cross-validated reduction.

    Training rows stack all periods; folds follow a hash of the key. Rows that lack a value keep
    their target unadjusted. Models: linear, ridge, lasso, boosting (trees).
    """
    if unknown := set(models) - {*LINEAR, "boosting"}:
        raise errors.InvalidArgumentError(f"unknown models {sorted(unknown)}: linear, ridge, lasso or boosting")
    if not plan.lags:
        raise errors.NoRequiredArgumentError(f"{plan.target} has no lag to learn from")
    width = min(len(c) for c in plan.covariates)
    names = [f"__f{i}" for i in range(width + 1)]

    def inputs(period: int) -> list[str]:
        """Columns that stand at ``period``: its covariates and the target's lag there."""
        return [*plan.covariates[period - 1][:width], plan.lags[period - 1]]

    known = [p for p in range(2, len(plan.lags) + 1) if p <= len(plan.covariates)]
    if not known:
        raise errors.NoRequiredArgumentError("two lags at least: one to predict, one to predict from")
    is_text = [isinstance(df.schema[c].dataType, T.StringType) for c in inputs(1)]
    raw = [f"__t{i}" if t else n for i, (n, t) in enumerate(zip(names, is_text, strict=True))]
    as_input = lambda c, t: column(c) if t else column(c).cast("double")
    stacked = None
    for p in known:
        one = df.select(*[as_input(c, t).alias(n) for c, n, t in zip(inputs(p), raw, is_text, strict=True)], column(plan.lags[p - 2]).cast("double").alias("__y"), F.pmod(F.xxhash64(column(key)), F.lit(folds)).alias("__fold"), F.concat(column(key).cast("string"), F.lit(f":{p}")).alias("__row"))
        stacked = one if stacked is None else stacked.unionByName(one)
    stacked = stacked.dropna()
    text = [i for i, t in enumerate(is_text) if t]
    tables, middle = [], 0.0
    if text or "boosting" in models:
        ws = Workspace(df.sparkSession, "cupac")
        stacked = ws.save(stacked, "rows")
        if text:
            stacked, tables, middle = target_statistics(stacked, "__row", [raw[i] for i in text], "__y", [names[i] for i in text])
            stacked = ws.save(stacked.drop(*[raw[i] for i in text]), "encoded")
            tables = [ws.save(t, "categories") for t in tables]
    parts = fold_moments(stacked, [*names, "__y"], "__fold")
    if not parts:
        raise errors.NoRequiredArgumentError(f"{plan.target} has no row with all values to learn from")
    whole = Moments.together(list(parts.values()))
    scores: dict[str, float] = {}
    weights: dict[str, list[float]] = {}
    for name in models:
        if name == "boosting":
            scores[name], weights[name] = _cross_validated_trees(stacked, names, folds)
            continue
        found = {f: linear_slopes(name, Moments.together([m for g, m in parts.items() if g != f])) for f in parts if len(parts) > 1}
        reductions = [_reduction(parts[f].cov[-1, -1], parts[f].left_over(b)) for f, b in found.items()]
        scores[name] = sum(reductions) / max(1, len(reductions))
        weights[name] = (sum(found.values()) / max(1, len(found)) if found else np.zeros(len(names))).tolist()
    best = max(scores, key=lambda m: scores[m])
    present = df
    for i, table in zip(text, tables, strict=True):
        named = table.select(F.col("category").alias(f"__category{i}"), F.col("encoded").alias(f"__encoded{i}"))
        present = present.join(named, column(inputs(1)[i]) == F.col(f"__category{i}"), "left")
    made = {n: F.when(column(c).isNotNull(), F.coalesce(F.col(f"__encoded{i}"), F.lit(middle))) if is_text[i] else column(c).cast("double") for i, (c, n) in enumerate(zip(inputs(1), names, strict=True))}
    present = present.withColumns(made)
    usable = F.lit(True)
    for c in names:
        usable &= F.col(c).isNotNull()
    if best == "boosting":
        from pyspark.ml.feature import VectorAssembler

        model = _boosted().fit(VectorAssembler(inputCols=names, outputCol="__x").transform(stacked))
        predicted = model.transform(VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="keep").transform(present))
        prediction: Column = F.col("__prediction")
    else:
        slopes = linear_slopes(best, whole)
        predicted = present
        prediction = F.lit(float(whole.mean[-1] - slopes @ whole.mean[:-1])) + sum((F.lit(float(b)) * F.col(n) for b, n in zip(slopes, names, strict=True)), F.lit(0.0))
    predicted = predicted.withColumn("__prediction", F.when(usable, prediction))
    mean = F.broadcast(predicted.agg(F.avg("__prediction").alias("__mean")))
    adjusted = column(plan.target) - F.coalesce(F.col("__prediction") - F.col("__mean"), F.lit(0.0))
    out = predicted.crossJoin(mean).withColumn(f"{plan.target}_cupac", adjusted)
    return out.select(*[column(c) for c in df.columns], f"{plan.target}_cupac"), CupacReport(plan.target, best, scores, dict(zip(inputs(1), weights[best], strict=True)))


def _cross_validated_trees(rows: DataFrame, names: Sequence[str], folds: int) -> tuple[float, list[float]]:
    """Mean reduction and mean importances of boosted trees, a fit for each fold."""
    from pyspark.ml.feature import VectorAssembler

    train = VectorAssembler(inputCols=list(names), outputCol="__x").transform(rows)
    reductions, found = [], []
    for fold in range(folds):
        model = _boosted().fit(train.filter(F.col("__fold") != fold))
        found.append([float(x) for x in model.featureImportances.toArray()])
        row = model.transform(train.filter(F.col("__fold") == fold)).agg(F.var_pop("__y").alias("v"), F.var_pop(F.col("__y") - F.col("__prediction")).alias("a")).first()
        if row["v"] is not None:
            reductions.append(_reduction(row["v"], row["a"]))
    return sum(reductions) / max(1, len(reductions)), [sum(x) / len(x) for x in zip(*found, strict=True)]


def diff_in_diff(df: DataFrame, group: str, before: str, after: str) -> DataFrame:
    """group, change (mean of after - before), effect against the least group."""
    changes = df.filter(column(group).isNotNull()).groupBy(column(group).alias("group")).agg(F.avg(column(after) - column(before)).alias("change"))
    control = changes.agg(F.min(F.struct("group", "change")).alias("c"))
    return changes.crossJoin(F.broadcast(control)).select("group", "change", (F.col("change") - F.col("c.change")).alias("effect"))
