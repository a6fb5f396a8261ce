"""The four experiments: A/A test, A/B test, homogeneity test and matching.

Each takes a RoleFrame and returns a dataclass of DataFrames. ``verdict`` columns read "OK" or
"NOT OK": in A/A and homogeneity tests a significant difference is not OK, in A/B tests it is OK.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..frame import RoleFrame
from ..operators import compare, matching, multitest, prep, split, variance
from ..operators.stats import column
from ..roles import NUMERIC, AdditionalFeatureRole, ConstGroupRole, FeatureRole, GroupingRole, StratificationRole, TargetRole, TreatmentRole
from ..storage import Workspace


def _one(frame: RoleFrame, role) -> str:
    found = frame.search_columns(role)
    if len(found) != 1:
        raise errors.NotSuitableFieldError(f"one column with {role.__name__} is needed, found {found}")
    return found[0]


def _targets(frame: RoleFrame) -> tuple[list[str], list[str]]:
    numeric, text = frame.search_columns(TargetRole, NUMERIC), frame.search_columns(TargetRole, [str])
    if not numeric and not text:
        raise errors.NoColumnsError("no column with TargetRole")
    return numeric, text


def run_tests(df: DataFrame, group: str, numeric: Sequence[str], text: Sequence[str], tests: Sequence[str], equal_var: bool = False, reliability: float = 0.05, mode: str = "groups", p_values: str = "auto") -> DataFrame:
    """Long table: feature, group, test, statistic, p_value, pass."""
    compare.check_groups(df, group)
    parts = []
    cells = None
    if numeric and {"ks-test", "u-test"} <= set(tests):  # both read the same counts
        cells = Workspace(df.sparkSession, "tests").save(compare.ranked_cells(compare.pairs(df, numeric, group, mode)), "cells")
    for name in tests:
        if name not in compare.TESTS:
            raise errors.InvalidArgumentError(f"test {name!r}; one of {sorted(compare.TESTS)}")
        columns = text if name in compare.TEXT_TESTS else numeric
        if columns:
            extra: dict[str, Any] = {"t-test": {"equal_var": equal_var}, "ks-test": {"p_values": p_values, "cells": cells}, "u-test": {"p_values": p_values, "cells": cells}}.get(name, {})
            found = compare.TESTS[name](df, columns, group, mode=mode, reliability=reliability, **extra)
            parts.append(found.select("feature", "group", F.lit(name).alias("test"), "statistic", "p_value", "pass"))
    if not parts:
        raise errors.NoColumnsError("no target suits the tests")
    return reduce(DataFrame.unionByName, parts)


def wide(results: DataFrame, tests: Sequence[str], significant_is_ok: bool) -> DataFrame:
    """One row per feature and group: p-value and verdict of each test."""
    ok = F.col("pass") if significant_is_ok else ~F.coalesce(F.col("pass"), F.lit(False))
    verdict = F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise("NOT OK")
    made = []
    for t in tests:
        here = F.col("test") == t
        made += [F.max(F.when(here, F.col("p_value"))).alias(f"{t} p-value"), F.max(F.when(here, verdict)).alias(f"{t} verdict")]
    return results.groupBy("feature", "group").agg(*made)


@dataclass(frozen=True)
class HomogeneityOutput:
    resume: DataFrame
    tests: DataFrame


@dataclass(frozen=True)
class HomogeneityTest:
    """Do the treatment groups differ? Pooled t, Kolmogorov-Smirnov and chi-square.

    ``p_values`` of KS and U tests: auto, exact or asymptotic.
    """

    tests: tuple[str, ...] = ("t-test", "ks-test", "chi2-test")
    equal_var: bool = True
    reliability: float = 0.05
    p_values: str = "auto"

    def execute(self, frame: RoleFrame) -> HomogeneityOutput:
        group = _one(frame, TreatmentRole)
        numeric, text = _targets(frame)
        found = run_tests(frame.df, group, numeric, text, self.tests, self.equal_var, self.reliability, p_values=self.p_values)
        resume = wide(found, self.tests, False)
        if numeric:
            resume = resume.join(compare.group_difference(frame.df, numeric, group), ["feature", "group"], "left")
        return HomogeneityOutput(resume, found)


@dataclass(frozen=True)
class ABOutput:
    resume: DataFrame
    tests: DataFrame
    sizes: DataFrame
    multitest: DataFrame | None = None
    best: Mapping[str, int] | None = None
    variance_reduction: DataFrame | None = None
    cupac: Mapping[str, variance.CupacReport] = field(default_factory=dict)


@dataclass(frozen=True)
class ABTest:
    """Differences and tests between the control and each arm.

    ``cuped`` maps targets to covariates; ``cupac`` plans need ``frame.key``. With more than two
    groups p-values are corrected by ``multitest_method`` within each test; "quantile" picks the
    best arm by simulation instead; None corrects nothing. ``p_values`` of KS and U tests: auto,
    exact or asymptotic.
    """

    tests: tuple[str, ...] = ("t-test",)
    multitest_method: str | None = "holm"
    equal_var: bool = False
    reliability: float = 0.05
    cuped: Mapping[str, str] | None = None
    cuped_theta: str = "ols"
    cupac: tuple[variance.CupacPlan, ...] = ()
    cupac_models: tuple[str, ...] = ("linear", "ridge", "lasso")
    p_values: str = "auto"

    def execute(self, frame: RoleFrame) -> ABOutput:
        group = _one(frame, TreatmentRole)
        df, reports, adjusted = frame.df, {}, {}
        for plan in self.cupac:
            df, reports[plan.target] = variance.cupac(df, plan, frame._order(), self.cupac_models)
            adjusted[plan.target] = f"{plan.target}_cupac"
        if self.cuped:
            df = variance.cuped(df, self.cuped, self.cuped_theta)
            adjusted |= {y: f"{y}_cuped" for y in self.cuped}
        numeric, text = _targets(frame)
        numeric = numeric + [c for c in (*(f"{p.target}_cupac" for p in self.cupac), *(f"{y}_cuped" for y in self.cuped or {}))]
        found = run_tests(df, group, numeric, text, self.tests, self.equal_var, self.reliability, p_values=self.p_values)
        resume = wide(found, self.tests, True)
        if numeric:
            resume = resume.join(compare.group_difference(df, numeric, group), ["feature", "group"], "left")
        sizes = compare.group_sizes(df, group)
        resume = resume.join(sizes.select("group", "control_size", "test_size"), "group", "left")
        corrected = best = None
        many = self.multitest_method is not None and df.filter(column(group).isNotNull()).select(column(group)).distinct().limit(3).count() > 2
        if many and self.multitest_method == "quantile":
            best = multitest.best_group(df, group, numeric, self.reliability)
        elif many:
            corrected = multitest.multitest(found.select("feature", "group", "test", "p_value"), self.multitest_method, self.reliability, ["test"])
        reduction = variance.variance_reduction(df, adjusted) if adjusted else None
        return ABOutput(resume, found, sizes, corrected, best, reduction, reports)


@dataclass(frozen=True)
class AAOutput:
    resume: DataFrame
    experiments: DataFrame
    scores: DataFrame
    aa_score: DataFrame
    best_seed: int
    best_split: RoleFrame
    best_split_statistic: DataFrame


@dataclass(frozen=True)
class AATest:
    """Many random splits, each tested; the share of significant ones should be the level.

    Splits are batched: ``batch`` seeds are exploded at a time and all their tests run as one
    plan keyed by seed, whatever the kind of split. With ``sample_size`` only that share of the rows
    is split, and the first seed without a significant test is taken, as if seeds were tried one
    by one (with ``compat`` the first that has one, as published). ``compat`` picks the split with
    the largest mean test score; otherwise p-values weigh two thirds.
    """

    n_iterations: int = 10
    seeds: tuple[int, ...] | None = None
    precision_mode: bool = False
    control_size: float = 0.5
    stratification: bool = False
    groups_sizes: tuple[float, ...] | None = None
    sample_size: float | None = None
    equal_var: bool = False
    reliability: float = 0.05
    tests: tuple[str, ...] = ("t-test", "ks-test")
    batch: int = 50
    compat: bool = False
    p_values: str = "auto"

    def _splitter(self, frame: RoleFrame, seed: int) -> split.Splitter:
        strata = tuple(frame.search_columns(StratificationRole)) if self.stratification else ()
        const = frame.search_columns(ConstGroupRole)
        return split.Splitter(frame._order(), seed, self.control_size, self.groups_sizes, strata, const[0] if const else None, self.sample_size)

    def _experiments(self, frame: RoleFrame, seeds: Sequence[int], numeric: Sequence[str], text: Sequence[str], ws: Workspace) -> DataFrame:
        """seed, feature, group, test, statistic, p_value, pass; the splits are stored once for all tests."""
        splitter = self._splitter(frame, 0)
        kept = [frame._order(), *splitter.strata, *([splitter.const] if splitter.const else []), *numeric, *text]
        spread = splitter.split_many(frame.df.select(*[column(c) for c in dict.fromkeys(kept)]), seeds).filter("split is not null")
        spread = ws.save(spread.select("seed", "split", *[column(c) for c in dict.fromkeys([*numeric, *text])]), "splits")
        parts = []  # each test runs once over all seeds
        for name in dict.fromkeys([*self.tests, *(["chi2-test"] if text else [])]):
            if columns := (text if name in compare.TEXT_TESTS else numeric):
                parts.append(_by_seed(spread, columns, name, self.equal_var, self.reliability, self.p_values))
        tested = ws.save(reduce(DataFrame.unionByName, parts), "tests")
        ws.drop(spread)
        return tested

    def _stop(self, tested: DataFrame, seeds: Sequence[int]) -> int | None:
        """The first of the seeds, in their order, that ends the search."""
        flags = {r["seed"]: r["some"] for r in tested.groupBy("seed").agg(F.coalesce(F.bool_or("pass"), F.lit(False)).alias("some")).collect()}
        return next((int(s) for s in seeds if s in flags and flags[s] == self.compat), None)

    def execute(self, frame: RoleFrame) -> AAOutput:
        numeric, text = _targets(frame)
        seeds = list(self.seeds or range(2000 if self.precision_mode else self.n_iterations))
        ws = Workspace(frame.df.sparkSession, "aa")
        parts = []
        for i in range(0, len(seeds), self.batch):
            part = self._experiments(frame, seeds[i : i + self.batch], numeric, text, ws)
            parts.append(part)
            if self.sample_size is not None and (stop := self._stop(part, seeds[i : i + self.batch])) is not None:
                parts = [part.filter(F.col("seed") == stop)]
                break
        tested = reduce(DataFrame.unionByName, parts)
        scores = split_scores(tested)
        weight = "mean_test_score" if self.compat else "score"
        best = scores.orderBy(F.desc(weight), "seed").first()["seed"]
        chosen = self._splitter(frame, int(best)).split(frame.df).filter("split is not null")
        names = list(dict.fromkeys([*self.tests, *(["chi2-test"] if text else [])]))
        best_split = RoleFrame(chosen, frame.roles | {"split": TreatmentRole(str)}, frame.key, _clean=True)
        detail = wide(tested.filter(F.col("seed") == best), names, False)
        if numeric:
            difference = ws.save(compare.group_difference(ws.save(chosen.select("split", *[column(c) for c in numeric]), "best"), numeric, "split"), "difference")
        statistic = detail.join(difference, ["feature", "group"], "left") if numeric else detail
        share = aa_score(tested, self.reliability)
        made = []
        for t in names:
            ok = F.when(F.col("ok"), "OK").otherwise("NOT OK")
            made.append(F.max(F.when(F.col("test") == t, ok)).alias(f"{t} aa test"))
        series = share.groupBy("feature", "group").agg(*made)
        verdicts = detail.select("feature", "group", *[F.col(f"{t} verdict").alias(f"{t} best split") for t in names])
        resume = series.join(verdicts, ["feature", "group"])
        either = reduce(lambda a, b: a | b, ((F.col(f"{t} aa test") == "OK") & (F.col(f"{t} best split") == "OK") for t in names))
        resume = resume.withColumn("result", F.when(F.coalesce(either, F.lit(False)), "OK").otherwise("NOT OK"))
        if numeric:
            resume = resume.join(difference, ["feature", "group"], "left")
        return AAOutput(resume, tested, scores, share, int(best), best_split, statistic)


def _by_seed(spread: DataFrame, columns: Sequence[str], test: str, equal_var: bool, reliability: float, p_values: str = "auto") -> DataFrame:
    """One test of all columns for all seeds at once: observations carry seed and feature as one name."""
    kind = "string" if test in compare.TEXT_TESTS else "double"
    cell = [F.struct(F.concat(F.col("seed").cast("string"), F.lit(":"), F.lit(c)).alias("name"), column(c).cast(kind).alias("value")) for c in columns]
    long = spread.select("split", F.explode(F.array(*cell)).alias("o")).select("split", "o.name", "o.value")
    options = {"t-test": {"equal_var": equal_var}, "ks-test": {"p_values": p_values}, "u-test": {"p_values": p_values}}.get(test, {})
    found = _long(compare.TESTS[test])(long, reliability, **options)
    parts = F.split("feature", ":", 2)
    return found.select(parts[0].cast("int").alias("seed"), parts[1].alias("feature"), "group", F.lit(test).alias("test"), "statistic", "p_value", "pass").select("feature", "group", "test", "statistic", "p_value", "pass", "seed")


def _long(test):
    """The test over rows (split, name, value): its observations are made from them directly."""

    def run(long: DataFrame, reliability: float, **options) -> DataFrame:
        observations = long.filter("value is not null").select(F.col("name").alias("feature"), F.when(F.col("split") != "control", F.col("split")).alias("label"), F.when(F.col("split") == "control", 1).otherwise(2).alias("side"), "value")
        return test(observations, [], reliability=reliability, observations=observations, **options)

    return run


def split_scores(tested: DataFrame) -> DataFrame:
    """seed, mean_test_score (t weighs 1, Kolmogorov-Smirnov 2, chi-square 2), mean_p, score = 2/3 mean_p + 1/3 mean_test_score."""
    weight = F.when(F.col("test") == "t-test", 1).otherwise(2)
    by_test = tested.groupBy("seed", "test").agg(F.avg(F.coalesce("p_value", F.lit(0.0))).alias("p")).withColumn("w", weight)
    by_seed = by_test.groupBy("seed").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("mean_test_score"))
    means = tested.groupBy("seed").agg(F.avg(F.coalesce("p_value", F.lit(0.0))).alias("mean_p"))
    return by_seed.join(means, "seed").withColumn("score", F.col("mean_p") * 2 / 3 + F.col("mean_test_score") / 3)


def aa_score(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """feature, group, test, score = 1 - |alpha - share of significant splits|, ok if it reaches 1 - 1.2 alpha."""
    share = F.avg(F.coalesce(F.col("pass"), F.lit(False)).cast("double"))
    out = tested.groupBy("feature", "group", "test").agg((1 - F.abs(F.lit(alpha) - share)).alias("score"))
    return out.withColumn("ok", F.col("score") >= 1 - 1.2 * alpha)


@dataclass(frozen=True)
class MatchingOutput:
    resume: DataFrame
    full_data: DataFrame
    indexes: DataFrame
    quality: DataFrame | None


@dataclass(frozen=True)
class Matching:
    """Treatment effects from nearest neighbours; group_match runs within each GroupingRole value.

    ``metric`` att or atc searches that side alone and gives that effect; ate gives all three.
    ``weights`` go by feature (a sequence in the features' order, or by name; an encoded category
    takes its column's, features without one weigh 1). Without ``encode_categories`` only
    numeric features place a unit. Numeric features are compared by the t and KS tests, text
    features by chi-square. Matches are stored once for all that reads them.
    """

    distance: str = "mahalanobis"
    metric: str = "ate"
    n_neighbors: int = 1
    bias_estimation: bool = True
    mode: str = "auto"
    group_match: bool = False
    weights: tuple[float, ...] | Mapping[str, float] | None = None
    encode_categories: bool = True
    quality_tests: tuple[str, ...] = ("t-test", "ks-test", "chi2-test")

    def __post_init__(self):
        if self.metric not in matching.SIDES:
            raise errors.InvalidArgumentError(f"metric {self.metric!r}; one of {sorted(matching.SIDES)}")

    def _weights(self, features: Sequence[str]) -> Sequence[float] | None:
        if not isinstance(self.weights, Mapping):
            return self.weights
        by_length = sorted(self.weights, key=len, reverse=True)
        return [next((self.weights[c] for c in by_length if f == c or f.startswith(f"{c}_")), 1.0) for f in features]

    def execute(self, frame: RoleFrame) -> MatchingOutput:
        """With group_match all groups are one plan: rows without a group are left out, outputs carry ``match_group``."""
        by = [_one(frame, GroupingRole)] if self.group_match else []
        if by:
            frame = frame.where(column(by[0]).isNotNull())
        key, group, target = frame._order(), _one(frame, TreatmentRole), frame.search_columns(TargetRole, NUMERIC)
        if not target:
            raise errors.NoColumnsError("no numeric column with TargetRole")
        numeric = frame.search_columns(FeatureRole, (*NUMERIC, bool))
        text = frame.search_columns(FeatureRole, [str])
        if self.distance == "mahalanobis":
            encoded = prep.dummy_encoder()(frame) if self.encode_categories else frame
            features = numeric + encoded.search_columns(AdditionalFeatureRole)
        elif self.distance == "l2":
            encoded, features = frame, numeric
        else:
            raise errors.InvalidArgumentError(f"distance {self.distance!r}: mahalanobis or l2")
        if not features:
            raise errors.NoColumnsError("no column with FeatureRole")
        df, space = encoded.df, features
        if self.distance == "mahalanobis":
            space, weights = [f"__w{i}" for i in range(len(features))], self._weights(features)
            df = matching.whitened(df, group, features, space, by, weights) if by else matching.linear(df, features, matching.whitening(df, group, features, weights), space)
        ws = Workspace(df.sparkSession, "matching")
        pairs = ws.save(matching.match_both(df, key, group, space, self.n_neighbors, mode=self.mode, metric=self.metric, by=by), "pairs")
        means = ws.save(matching.matched_means(encoded.df, key, pairs, [*features, *target], text), "matched")
        resumes = []
        for y in target:
            slopes = None
            if self.bias_estimation:
                slopes = matching.bias_slopes(means, group, y, features, by) if by else matching.bias_coefficients(means, group, y, features)
            units = matching.unit_effects(means, key, group, y, features, slopes, by)
            found = matching.effects(units, pairs, self.n_neighbors, by).withColumn("target", F.lit(y))
            resumes.append(found if self.metric == "ate" else found.filter(F.col("metric") == self.metric.upper()))
        resume = reduce(DataFrame.unionByName, resumes)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "match"))), lambda s: s["match"])
        indexes = pairs.groupBy("query").agg(ordered.alias("matches"))
        quality = None
        tested = [f for f in numeric if frame.roles[f].data_type in NUMERIC]
        names = [t for t in self.quality_tests if (text if t in compare.TEXT_TESTS else tested)]
        if by:
            tag = column(by[0]).cast("string").alias("match_group")
            resume = resume.withColumn("match_group", tag).drop(by[0])
            indexes = indexes.join(means.select(matching.key_of(means, key).alias("query"), tag), "query")
        if names:
            quality = _quality_by_group(means, by[0], group, tested, text, names) if by else run_tests(means, group, tested, text, names, True, 0.05, "matched_pairs")
        return MatchingOutput(resume, means, indexes, quality)


def _quality_by_group(means: DataFrame, by: str, group: str, numeric: Sequence[str], text: Sequence[str], tests: Sequence[str]) -> DataFrame:
    """Tests of matched pairs within each group: observations carry the group before the feature's name."""
    parts = []
    for name in tests:
        columns, kind = (text, "string") if name in compare.TEXT_TESTS else (numeric, "double")
        named = lambda f: F.concat_ws("\u001f", F.lit(f), column(by).cast("string"))
        cells = [F.struct(named(f).alias("feature"), column(group).cast("string").alias("label"), F.lit(side).alias("side"), column(c).cast(kind).alias("value")) for f in columns for side, c in ((1, f"{f}_matched"), (2, f))]
        observations = means.select(F.explode(F.array(*cells)).alias("o")).select("o.*").filter("value is not null and label is not null")
        extra: dict[str, Any] = {"equal_var": True} if name == "t-test" else {}
        found = compare.TESTS[name](observations, columns, observations=observations, reliability=0.05, **extra)
        split_ = F.split("feature", "\u001f", 2)
        parts.append(found.select(split_[0].alias("feature"), "group", F.lit(name).alias("test"), "statistic", "p_value", "pass", split_[1].alias("match_group")))
    return reduce(DataFrame.unionByName, parts)


__all__ = ["AAOutput", "AATest", "ABOutput", "ABTest", "HomogeneityOutput", "HomogeneityTest", "Matching", "MatchingOutput", "aa_score", "run_tests", "split_scores", "wide"]
