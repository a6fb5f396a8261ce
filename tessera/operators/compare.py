"""Two-sample comparisons of features between groups, or between columns.

``pairs`` brings every mode to one shape, observations (feature, label, side, value): side 1 is
the baseline, side 2 what is compared; a baseline without a label serves all labels. Each test
aggregates the observations once, by side for moments or by distinct value for rank and category
tests, and joins the small tables of both sides.

Modes: ``groups`` (the least group against each other one), ``columns`` (a baseline column
against each feature), ``columns_in_groups`` (the same within each group), ``cross`` (the
baseline column in the control group against features in the others), ``matched_pairs`` (a
feature against ``<feature>_matched`` within each group).

A test takes ready ``observations`` in place of a table and columns. ``pass`` is true for a significant difference (p below ``reliability``), null without a p-value.
Differences are test minus control. Chi-square joins categories by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..functions import special
from ..functions.ranking import cumulative
from ..storage import Workspace
from .stats import column

MODES = ("groups", "columns", "columns_in_groups", "cross", "matched_pairs")
POOL_BELOW = 7  # categories with fewer rows in a sample are pooled
P_VALUES = ("auto", "exact", "asymptotic")
KS_EXACT, U_EXACT = 10_000, 8  # "auto" is exact up to this many rows in the larger (KS) or the smaller sample (U)
MOST_GROUPS = 10_000
U_CELLS = 20_000_000  # values of U up to which its distribution is counted


def check_groups(df: DataFrame, group: str, most: int = MOST_GROUPS) -> None:
    """Tables of a row for each feature and group are sent to the observations, so groups must be few; reads the group column alone."""
    if df.filter(column(group).isNotNull()).select(column(group)).distinct().limit(most + 1).count() > most:
        raise errors.NotSuitableFieldError(f"{group} has more than {most} groups: compare fewer at a time")


def pairs(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, kind: str = "double") -> DataFrame:
    """(feature, label, side, value) with null values dropped."""
    if mode not in MODES:
        raise errors.InvalidArgumentError(f"mode {mode!r}; one of {MODES}")
    if not features:
        raise errors.NoColumnsError("there is no target to compare")
    if mode != "columns" and group is None:
        raise errors.NotSuitableFieldError("a grouping column is needed")
    if mode in ("columns", "columns_in_groups", "cross") and baseline is None:
        raise errors.NoRequiredArgumentError("baseline")

    def cell(feature: str, label: Column, side: Column | int, value: str) -> Column:
        side = side if isinstance(side, Column) else F.lit(side)
        return F.struct(F.lit(feature).alias("feature"), label.cast("string").alias("label"), side.alias("side"), column(value).cast(kind).alias("value"))

    none = F.lit(None)
    if mode == "columns":
        cells = [c for f in features for c in (cell(f, F.lit("all"), 1, baseline), cell(f, F.lit("all"), 2, f))]
    else:
        df = df.filter(column(group).isNotNull())
        g = column(group)
        if mode in ("groups", "cross"):
            df = df.crossJoin(F.broadcast(df.agg(F.min(g).alias("__control"))))
            control = g == F.col("__control")
            side, label = F.when(control, 1).otherwise(2), F.when(~control, g.cast("string"))
            if mode == "groups":
                cells = [cell(f, label, side, f) for f in features]
            else:
                cells = [F.when(control, cell(f, none, 1, baseline)).otherwise(cell(f, g, 2, f)) for f in features]
        else:
            before = (lambda f: f"{f}_matched") if mode == "matched_pairs" else (lambda f: baseline)
            cells = [c for f in features for c in (cell(f, g, 1, before(f)), cell(f, g, 2, f))]
    return df.select(F.explode(F.array(*cells)).alias("o")).select("o.*").filter("value is not null")


def _sides(table: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "inner") -> DataFrame:
    """Baseline values <v>1 beside compared values <v>2, by feature, group and further keys."""
    base = table.filter("side = 1").select(F.col("feature").alias("__f"), F.col("label").alias("__l"), *[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(f"{v}1") for v in values])
    test = table.filter("side = 2").select("feature", F.col("label").alias("group"), *keys, *[F.col(v).alias(f"{v}2") for v in values])
    cond = (F.col("feature") == F.col("__f")) & (F.col("__l").isNull() | (F.col("__l") == F.col("group")))
    for k in keys:
        cond &= F.col(k) == F.col(f"__{k}")
    return test.join(base, cond, how).drop("__f", "__l", *[f"__{k}" for k in keys])


def moments(observations: DataFrame) -> DataFrame:
    """feature, group, and n, mean, var of both sides."""
    table = observations.groupBy("feature", "label", "side").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return _sides(table, [], ["n", "mean", "var"])


def group_difference(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None) -> DataFrame:
    m = moments(pairs(df, features, group, mode, baseline))
    return m.select("feature", "group", F.col("mean1").alias("control_mean"), F.col("mean2").alias("test_mean"), (F.col("mean2") - F.col("mean1")).alias("difference"), ((F.try_divide(F.col("mean2"), F.col("mean1")) - 1) * 100).alias("difference_pct"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows of the control (least group) and each other one, and their shares of both together."""
    counts = df.filter(column(group).isNotNull()).groupBy(column(group).alias("g")).agg(F.count("*").alias("n"))
    low = F.broadcast(counts.agg(F.min(F.struct("g", "n")).alias("c")))
    both = counts.crossJoin(low).filter(F.col("g") != F.col("c.g"))
    c, t = F.col("c.n"), F.col("n")
    return both.select(F.col("g").cast("string").alias("group"), c.alias("control_size"), t.alias("test_size"), (c / (c + t) * 100).alias("control_size_pct"), (t / (c + t) * 100).alias("test_size_pct"))


def _tested(table: DataFrame, p: Column, reliability: float, *kept: str) -> DataFrame:
    table = table.withColumn("p_value", p)
    return table.select("feature", "group", *kept, "statistic", "p_value", (F.col("p_value") < reliability).alias("pass"))


def t_test(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, equal_var: bool = True, reliability: float = 0.05, observations: DataFrame | None = None) -> DataFrame:
    """Student's (pooled) or Welch's test; the statistic is control minus test."""
    m = moments(observations if observations is not None else pairs(df, features, group, mode, baseline))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    if equal_var:
        dof = (n1 + n2 - 2).cast("double")
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof)
        error = F.sqrt(pooled * (1 / n1 + 1 / n2))
    else:
        a, b = v1 / n1, v2 / n2
        error = F.sqrt(a + b)
        dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    m = m.withColumn("statistic", F.try_divide(F.col("mean1") - F.col("mean2"), error)).withColumn("df", dof)
    return _tested(m, special.t_two_sided_column(F.col("statistic"), F.col("df")), reliability, "df")


def _counted(observations: DataFrame) -> DataFrame:
    """feature, group, value, c1, c2: how often each distinct value occurs on either side."""
    counts = observations.groupBy("feature", "label", "side", "value").agg(F.count("*").cast("double").alias("c"))
    counts = Workspace(observations.sparkSession, "tests").save(counts, "counts")  # read once for each side and for the labels
    base, test = counts.filter("side = 1"), counts.filter("side = 2")
    labels = test.select("feature", F.col("label").alias("group")).distinct()
    cond = (F.col("feature") == F.col("__f")) & (F.col("label").isNull() | (F.col("label") == F.col("group")))
    first = F.broadcast(labels).join(base.withColumnRenamed("feature", "__f"), cond).select("feature", "group", "value", F.col("c").alias("c1"), F.lit(0.0).alias("c2"))
    second = test.select("feature", F.col("label").alias("group"), "value", F.lit(0.0).alias("c1"), F.col("c").alias("c2"))
    return first.unionByName(second).groupBy("feature", "group", "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))


def ranked_cells(observations: DataFrame) -> DataFrame:
    """feature, group, value, c1, c2 and their running sums c1__upto, c2__upto: all that rank tests need."""
    return cumulative(_counted(observations), ["feature", "group"], "value", ["c1", "c2"])


def _exact(method: str, fits: Column) -> Column:
    if method not in P_VALUES:
        raise errors.InvalidArgumentError(f"p_values {method!r}; one of {P_VALUES}")
    return F.lit(False) if method == "asymptotic" else F.lit(True) if method == "exact" else fits


def ks_test(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, reliability: float = 0.05, observations: DataFrame | None = None, p_values: str = "auto", cells: DataFrame | None = None) -> DataFrame:
    """Two-sided Kolmogorov-Smirnov distance.

    p_values: "exact" counts lattice paths, "asymptotic" is the limit distribution, "auto" is exact
    up to KS_EXACT rows in the larger sample. ``cells`` of ``ranked_cells`` serve this test and ``u_test``.
    """
    if cells is None:
        cells = ranked_cells(observations if observations is not None else pairs(df, features, group, mode, baseline))
    total = cells.groupBy(F.col("feature").alias("__f"), F.col("group").alias("__g")).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    cells = cells.join(F.broadcast(total), (F.col("feature") == F.col("__f")) & (F.col("group") == F.col("__g")))
    gap = F.abs(F.try_divide(F.col("c1__upto"), F.col("n1")) - F.try_divide(F.col("c2__upto"), F.col("n2")))
    out = cells.groupBy("feature", "group").agg(F.max(gap).alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    scaled = F.col("statistic") * F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    exact = _exact(p_values, F.greatest(n1, n2) <= KS_EXACT) & (n1 > 0) & (n2 > 0)
    p = special.kolmogorov_upper_column(scaled)
    if p_values != "asymptotic":
        p = F.when(exact, special.ks_exact_column(F.when(exact, F.col("statistic")), n1, n2)).otherwise(p)
    return _tested(out, p, reliability)


def u_test(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, reliability: float = 0.05, observations: DataFrame | None = None, p_values: str = "auto", cells: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney U of the control.

    p_values: "exact" counts orders without ties, "asymptotic" is the normal approximation with tie
    and continuity corrections, "auto" is exact without ties and with U_EXACT rows or fewer in the
    smaller sample. Samples with more than U_CELLS values of U are always approximated.
    """
    if cells is None:
        cells = ranked_cells(observations if observations is not None else pairs(df, features, group, mode, baseline))
    c = F.col("c1") + F.col("c2")
    rank = F.col("c1__upto") + F.col("c2__upto") - (c - 1) / 2
    out = cells.groupBy("feature", "group").agg(F.sum(F.col("c1") * rank).alias("r1"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(c * c * c - c).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    out = out.withColumn("statistic", F.col("r1") - n1 * (n1 + 1) / 2)
    larger = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(larger - n1 * n2 / 2 - 0.5, sigma)
    p = F.least(F.lit(1.0), F.when(z > 0, special.normal_two_sided_column(F.greatest(z, F.lit(0.0)))).when(z.isNotNull(), 1.0))
    if p_values != "asymptotic":
        exact = _exact(p_values, (F.least(n1, n2) <= U_EXACT) & (F.col("ties") == 0)) & (n1 > 0) & (n2 > 0) & (n1 * n2 <= U_CELLS)
        p = F.when(exact, special.u_exact_column(F.when(exact, larger), n1, n2)).otherwise(p)
    return _tested(out, p, reliability)


def chi2_test(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, reliability: float = 0.05, observations: DataFrame | None = None) -> DataFrame:
    """Chi-square over category counts.

    In each sample categories with fewer than 7 rows are pooled to "other", which is dropped if it
    stays below 7; control counts are weighted by the test's share and the reverse; Yates'
    correction at one degree of freedom; null where the control keeps fewer than two categories.
    """
    cells = _counted(observations if observations is not None else pairs(df, features, group, mode, baseline, "string"))
    side = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("c1").alias("c")), F.struct(F.lit(2).alias("side"), F.col("c2").alias("c"))))
    long = cells.select("feature", "group", "value", side.alias("s")).select("feature", "group", "value", "s.side", "s.c").filter("c > 0")
    sizes = long.groupBy(F.col("feature").alias("__f"), F.col("group").alias("__g")).agg(F.sum(F.when(F.col("side") == 1, F.col("c"))).alias("n1"), F.sum(F.when(F.col("side") == 2, F.col("c"))).alias("n2"))
    pooled = long.groupBy("feature", "group", "side", F.when(F.col("c") < POOL_BELOW, "other").otherwise(F.col("value")).alias("category")).agg(F.sum("c").alias("c"))
    pooled = pooled.filter((F.col("category") != "other") | (F.col("c") >= POOL_BELOW)).join(F.broadcast(sizes), (F.col("feature") == F.col("__f")) & (F.col("group") == F.col("__g")))
    share = F.col("n1") / (F.col("n1") + F.col("n2"))
    weighted = pooled.withColumn("w", F.col("c") * F.when(F.col("side") == 1, 1 - share).otherwise(share))
    wide = weighted.groupBy("feature", "group", "category").agg(F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("w"))), F.lit(0.0)).alias("o1"), F.coalesce(F.sum(F.when(F.col("side") == 2, F.col("w"))), F.lit(0.0)).alias("o2"))
    totals = wide.groupBy(F.col("feature").alias("__f"), F.col("group").alias("__g")).agg(F.sum("o1").alias("t1"), F.sum("o2").alias("t2"), F.count("*").alias("k"), F.count_if(F.col("o1") > 0).alias("k1"))
    both = wide.join(F.broadcast(totals), (F.col("feature") == F.col("__f")) & (F.col("group") == F.col("__g")))
    row = F.col("o1") + F.col("o2")
    total = F.col("t1") + F.col("t2")

    def term(o: Column, t: Column) -> Column:
        e = row * t / total
        off = F.abs(o - e)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, e)

    out = both.groupBy("feature", "group").agg(F.sum(term(F.col("o1"), F.col("t1")) + term(F.col("o2"), F.col("t2"))).alias("s"), F.max("k").alias("k"), F.max("k1").alias("k1"))
    fits = F.col("k1") >= 2
    out = out.select("feature", "group", F.when(fits, F.col("s")).alias("statistic"), F.when(fits, F.col("k") - 1).cast("double").alias("df"))
    return _tested(out, special.chi2_upper_column(F.col("statistic"), F.col("df")), reliability, "df")


def psi(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index over equal-width bins of the control's range; outer values fall into the end bins."""
    o = pairs(df, features, group, mode, baseline)
    span = o.filter("side = 1").groupBy(F.col("feature").alias("__f"), F.col("label").alias("__l")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    placed = o.join(F.broadcast(span), (F.col("feature") == F.col("__f")) & (F.col("__l").isNull() | F.col("__l").eqNullSafe(F.col("label"))))
    share = F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins))).cast("int")
    shares = placed.groupBy("feature", "label", "side").agg(F.count("*").alias("n"), *[F.count_if(at == i).alias(f"b{i}") for i in range(bins)])
    both = _sides(shares.withColumn("p", F.array(*[F.greatest(F.lit(floor), F.col(f"b{i}") / F.col("n")) for i in range(bins)])), [], ["p"])
    terms = F.zip_with("p1", "p2", lambda p, q: (q - p) * F.ln(q / p))
    return both.select("feature", "group", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("psi"))


def smd(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None) -> DataFrame:
    """Standardised mean difference, by the control's deviation."""
    m = moments(pairs(df, features, group, mode, baseline))
    return m.select("feature", "group", F.try_divide(F.col("mean2") - F.col("mean1"), F.sqrt("var1")).alias("smd"))


def mde_by_size(df: DataFrame, features: Sequence[str], group: str, significance: float = 0.95, power: float = 0.8) -> DataFrame:
    """Minimal detectable effect at the groups' sizes."""
    z = special.normal_quantile((1 + significance) / 2) + special.normal_quantile(power)
    m = moments(pairs(df, features, group))
    return m.select("feature", "group", (F.lit(z) * F.sqrt(F.col("var2") / F.col("n2") + F.col("var1") / F.col("n1"))).alias("mde"))


TESTS: dict[str, Callable[..., DataFrame]] = {"t-test": t_test, "ks-test": ks_test, "u-test": u_test, "chi2-test": chi2_test}
TEXT_TESTS = {"chi2-test"}  # tests of text targets; all others take numbers


def register_test(name: str, test: Callable[..., DataFrame], text: bool = False) -> None:
    """Makes a test known to all experiments by its name.

    It is called as test(df, features, group, mode=..., baseline=..., reliability=..., observations=...)
    and returns (feature, group, statistic, p_value, pass); ``sample_test`` makes one of a Python function.
    """
    if name in TESTS:
        raise errors.InvalidArgumentError(f"there is a test {name!r} already")
    TESTS[name] = test
    if text:
        TEXT_TESTS.add(name)


def forget_test(name: str) -> None:
    if name in ("t-test", "ks-test", "u-test", "chi2-test"):
        raise errors.InvalidArgumentError(f"{name!r} is built in")
    TESTS.pop(name, None)
    TEXT_TESTS.discard(name)


def sample_test(function: Callable[[np.ndarray, np.ndarray], tuple[float, float]], kind: str = "double", most: int = 1_000_000) -> Callable[..., DataFrame]:
    """A test of (control's values, test's values) -> (statistic, p-value).

    Both samples of a feature and group are held by one task, so they may have ``most`` rows
    together at most; a baseline without a label is sent to every group.
    """

    def test(df: DataFrame, features: Sequence[str], group: str | None = None, mode: str = "groups", baseline: str | None = None, reliability: float = 0.05, observations: DataFrame | None = None) -> DataFrame:
        o = observations if observations is not None else pairs(df, features, group, mode, baseline, kind)
        sizes = o.groupBy("feature", "label", "side").agg(F.count("*").alias("n"))
        both = _sides(sizes, [], ["n"])
        largest = both.agg(F.max(F.col("n1") + F.col("n2"))).first()[0] or 0
        if largest > most:
            raise errors.InvalidArgumentError(f"a test in Python takes {most} rows of a feature and group at most, there are {largest}: raise most, or write the test over aggregates")
        labels = both.select(F.col("feature").alias("f"), "group")
        there = o.join(labels, (F.col("feature") == F.col("f")) & (F.col("label").isNull() | (F.col("label") == F.col("group")))).select("feature", "group", "side", "value")

        def work(rows: pd.DataFrame) -> pd.DataFrame:
            statistic, p = function(*(rows.loc[rows["side"] == s, "value"].to_numpy() for s in (1, 2)))
            return pd.DataFrame({"feature": rows["feature"].iloc[:1], "group": rows["group"].iloc[:1], "statistic": [float(statistic)], "p": [float(p)]})

        found = there.groupBy("feature", "group").applyInPandas(work, "feature string, group string, statistic double, p double")
        return _tested(found, F.nanvl("p", F.lit(None).cast("double")), reliability)

    return test
