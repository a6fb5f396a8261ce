"""The analytics operators against literals, pandas, commons-math and known effects."""

import hashlib
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.frame import RoleFrame
from tessera.functions import ranking, special
from tessera.operators import compare, matching, multitest, prep, split, stats, variance
from tessera.plans import flow, shells
from tessera.roles import AdditionalFeatureRole, ConstGroupRole, FeatureRole, GroupingRole, InfoRole, StratificationRole, TargetRole, TreatmentRole, column_roles
from tessera.sources import readers, synthetic


@pytest.fixture(scope="module")
def small(spark):
    return RoleFrame.from_dict(spark, {"k": [1, 2, 3], "a": [1, 2, 3], "b": [4.0, None, 6.0]}, {InfoRole(): ["a"]}, "k")


def values(frame, column):
    return [r[column] for r in frame.df.orderBy("k").collect()]


def test_groups_of_another_frame_counts_and_sql(spark):
    frame = RoleFrame.from_dict(spark, {"k": [1, 2, 3, 4], "g": ["x", "y", "x", None], "a": [1, 2, 4, 8]}, {TargetRole(): ["a"]}, "k")
    groups = RoleFrame.from_dict(spark, {"k": [4, 3, 2, 1], "a": ["v", "u", "u", None]}, key="k")
    parts = frame.groupby(groups)
    assert [(key, sorted(r["a"] for r in part.df.collect())) for key, part in parts] == [("u", [2, 4]), ("v", [8])]
    assert all(part.columns == frame.columns and part.key == "k" and part.roles["a"].name == "Target" for _, part in parts)
    by_name, by_frame = frame.groupby("g", ["sum", "mean"], ["a"]).df, frame.groupby(frame.select(["g"]), ["sum", "mean"], ["a"]).df
    assert by_frame.columns == by_name.columns and sorted(map(tuple, by_frame.collect())) == sorted(map(tuple, by_name.collect()))
    with pytest.raises(errors.DataTypeError):
        frame.groupby(frame)

    counted = frame.select(["g"])
    assert [r["count"] for r in counted.drop("k").value_counts(ascending=True).df.collect()] == [1, 2]
    assert [r["count"] for r in counted.drop("k").value_counts(dropna=False).df.collect()] == [2, 1, 1]
    assert {r["g"]: r["proportion"] for r in counted.drop("k").value_counts(normalize=True, sort=False, dropna=False).df.collect()} == {"x": 0.5, "y": 0.25, None: 0.25}

    found = frame.sql("SELECT f.k, f.a, g.a AS own, a_sum FROM {frame} f JOIN {groups} g USING (k), (SELECT sum(a) AS a_sum FROM {frame}) WHERE f.a > 1", groups=groups)
    assert sorted(map(tuple, found.df.collect())) == [(2, 2, "u", 15), (3, 4, "u", 15), (4, 8, "v", 15)]
    assert found.key == "k" and found.roles["a"].name == "Target" and found.roles["a_sum"].name == "Default"


def test_python_aggregates(spark):
    frame = RoleFrame.from_dict(spark, {"k": [1, 2, 3, 4], "g": ["x", "y", "x", None], "a": [1.0, 2.0, None, 8.0]}, key="k")

    def spread(values):
        return values.max() - values.min()

    assert frame.agg(spread, ["a"]).scalar() == 7
    assert frame.agg([spread, len], ["a"]).df.first().asDict() == {"a_spread": 7, "a_len": 4}
    assert {r["g"]: r["a"] for r in frame.groupby("g", len, ["a"]).df.collect()} == {"x": 2, "y": 1}
    assert frame.new(frame.df.filter("k > 9")).agg(spread, ["a"]).scalar() is None
    with pytest.raises(errors.InvalidArgumentError):
        frame.agg(["mean", spread], ["a"])
    with pytest.raises(errors.InvalidArgumentError):
        stats.aggregate_python(frame.df, ["a"], len, most=3)


def test_roles(small):
    assert small.roles["a"].data_type is int and small.roles["b"].name == "Default"
    assert small.search_columns(InfoRole) == ["a"]
    assert small.search_columns_by_type(float) == ["b"]
    assert small.replace_roles({InfoRole: TargetRole}).search_columns(TargetRole) == ["a"]
    assert isinstance(FeatureRole().as_additional(), AdditionalFeatureRole)
    assert set(column_roles({TargetRole(): ["x", "y"], "z": FeatureRole})) == {"x", "y", "z"}
    with pytest.raises(errors.RoleColumnError):
        RoleFrame(small.df, {TargetRole(): ["nope"]})


def test_selection(small):
    assert small["a"].columns == ["k", "a"] and small[["a", "b"]].shape == (3, 3)
    assert values(small.iloc(slice(1, 3)), "a") == [2, 3] and values(small.iloc(0), "a") == [1]
    assert small.loc([1, 3], ["a"]).get_values(column="a") == [1, 3]
    assert small.get_values(2, "a") == 2 and small.iget_values(0, "a") == 1 and small.index == [1, 2, 3]
    assert values(small.loc_set(2, "a", 9), "a") == [1, 9, 3]
    assert values(small.iloc_set(2, "a", 9), "a") == [1, 2, 9]
    assert small.get("zz", 5) == 5 and small.take([1], axis=1).columns == ["k", "b"]
    assert values(small[small["a"] > 1], "a") == [2, 3]
    assert values(small.mask(small.isna()), "b") == [None, None, None]
    assert small.drop(columns="a").columns == ["k", "b"] and values(small.drop(keys=[1]), "k") == [2, 3]
    assert small.filter(regex="^a$").columns == ["k", "a"]
    assert values(small.reindex([3, 7], 0), "a") == [3, 0]
    with pytest.raises(errors.DataTypeError):
        small.loc_set(1, "a", "text")
    with pytest.raises(errors.NoRequiredArgumentError):
        RoleFrame(small.df).iloc(0)


def test_arithmetic(small):
    a = small["a"]
    assert values(a + 1, "a") == [2, 3, 4] and values(1 - a, "a") == [0, -1, -2] and values(2**a, "a") == [2, 4, 8]
    assert values((a - 4) // 2, "a") == [-2, -1, -1] and values((a - 4) % 2, "a") == [1, 0, 1]
    assert values(a / 0, "a") == [None] * 3 and values(a + a, "a") == [2, 4, 6]
    assert values(((a > 1) & (a < 3)) ^ (a == 3), "a") == [False, True, True]
    assert values(~(a > 1), "a") == [True, False, False] and values(abs(-a), "a") == [1, 2, 3]
    assert values((a * 0.5).round(), "a") == [0, 1, 2]
    assert values(a.replace({1: 10}), "a") == [10, 2, 3]
    assert values(small["b"].fillna({"b": 0.0}), "b") == [4, 0, 6]
    assert values(small.fillna(method="ffill"), "b") == [4, 4, 6] and values(small.fillna(method="bfill"), "b") == [4, 6, 6]
    assert values(small.dropna(), "k") == [1, 3] and small.dropna(axis=1).columns == ["k", "a"]
    assert values(small.dot([[1, 0], [0, 2]], ["p", "q"]), "q") == [8, None, 12]
    assert small.astype({"a": str}).roles["a"].data_type is str
    assert small.update_column_type("b", int).roles["b"].data_type is float


def test_nan_is_null(spark):
    frame = RoleFrame(spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, x double"), {}, "k")
    assert frame["x"].mean().scalar() == 1.0 and frame.na_counts().df.first()["x"] == 1


def test_joins(spark, small):
    right = RoleFrame.from_dict(spark, {"k": [2, 3, 4], "a": [7, 8, 9]}, {}, "k")
    assert small.merge(right, on="k").columns == ["k", "a_x", "b", "a_y"]
    assert len(small.merge(right, how="outer")) == 4 and len(small.merge(right, how="cross")) == 9
    assert len(small.append(right)) == 6 and small.append(right.rename({"a": "c"}), axis=1).shape == (4, 4)
    with pytest.raises(errors.MergeOnError):
        small.merge(right, on="zz")
    with pytest.raises(errors.DataTypeError):
        small.merge("x")
    with pytest.raises(errors.ConcatDataError):
        small.append("x")


def test_aggregates_against_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": range(200), "x": rng.normal(size=200).round(1), "y": rng.integers(0, 5, 200).astype(float)})
    frame = RoleFrame(spark.createDataFrame(pdf), {}, "k")
    xy = pdf[["x", "y"]]
    for name in ("sum", "mean", "min", "max", "std", "var"):
        assert np.allclose(list(frame.agg(name).df.first()), xy.agg(name))
    assert math.isclose(frame["x"].var(ddof=0).scalar(), pdf.x.var(ddof=0))
    assert np.allclose([r.x for r in frame.quantile([0.1, 0.9]).df.orderBy("q").collect()], pdf.x.quantile([0.1, 0.9]))
    for method in ("pearson", "spearman", "kendall"):
        found = {(r.column_a, r.column_b): r.value for r in frame.corr(method).df.collect()}
        if method == "kendall":
            pairs = [(np.sign(a - c) * np.sign(b - d), np.sign(a - c) ** 2, np.sign(b - d) ** 2) for (a, b) in xy.to_numpy() for (c, d) in xy.to_numpy()]
            s, p, q = map(sum, zip(*pairs, strict=True))
            assert math.isclose(found["x", "y"], s / math.sqrt(p * q), abs_tol=1e-9)
        else:
            ranks = xy.rank() if method == "spearman" else xy
            assert math.isclose(found["x", "y"], ranks.corr().loc["x", "y"], abs_tol=1e-9)
    assert frame.idxmax().df.first()["x"] == pdf.k[pdf.x.idxmax()]
    assert {r.value for r in frame.mode(["y"]).df.collect()} == {str(v) for v in pdf.y.mode()}
    assert frame.nunique() == {"x": pdf.x.nunique(), "y": pdf.y.nunique()}
    assert [k for k, _ in frame.groupby("y")] == sorted(pdf.y.unique())
    assert frame.sample(n=17, seed=2).df.count() == 17


def test_ranks_and_positions(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.permutation(500).astype(float), "c": 1.0}))
    out = ranking.cumulative(df, ["g"], "v", ["c"], buckets=7).toPandas().sort_values(["g", "v"])
    assert (out["c__upto"] == out.groupby("g").cumcount() + 1).all()
    ranked = ranking.hash_rank(df, "v", 5, ["g"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert sorted(part["__rank"]) == list(range(1, len(part) + 1)) and (part["__n"] == len(part)).all()
    text = spark.createDataFrame([(x,) for x in ("b", "abc", "abd", "a")], "t string")
    assert [r.t for r in ranking.position(text, "t", "p").orderBy("p").collect()] == ["a", "abc", "abd", "b"]


def test_special_functions(spark):
    d = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 3.3, 57.4, 900.5):
        for t in (0.0, 0.3, 2.0, 12.0):
            assert math.isclose(special.t_two_sided(t, df), 2 * d.TDistribution(df).cumulativeProbability(-t), rel_tol=1e-8, abs_tol=1e-13)
            assert math.isclose(special.chi2_upper(t, df), 1 - d.ChiSquaredDistribution(df).cumulativeProbability(t), rel_tol=1e-7, abs_tol=1e-12)
    ks = spark.sparkContext._jvm.org.apache.commons.math3.stat.inference.KolmogorovSmirnovTest()
    for x in (0.3, 0.8, 1.0, 1.5):
        assert math.isclose(special.kolmogorov_upper(x), 1 - ks.ksSum(x, 1e-12, 100000), abs_tol=1e-9)
    assert math.isclose(special.normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    row = spark.createDataFrame([(2.0, 10.0), (None, 1.0)], "t double, d double").select(special.t_two_sided_column(F.col("t"), F.col("d")).alias("p")).collect()
    assert math.isclose(row[0].p, special.t_two_sided(2.0, 10.0)) and row[1].p is None


@pytest.fixture(scope="module")
def arms(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"id": range(900), "g": np.repeat(["a", "b", "c"], 300), "x": rng.normal(size=900).round(2), "c": rng.choice(["p", "q", "r"], 900)})
    pdf.loc[pdf.g == "c", "x"] += 0.5
    return spark.createDataFrame(pdf), pdf


def test_two_sample_tests(arms, spark):
    df, pdf = arms
    inference = spark.sparkContext._jvm.org.apache.commons.math3.stat.inference
    to_java = lambda v: _array(spark, v)
    a = pdf.x[pdf.g == "a"].to_numpy()
    for g in "bc":
        b = pdf.x[pdf.g == g].to_numpy()
        pick = lambda t: t.filter(F.col("group") == g).first()  # noqa: E731, B023
        welch = pick(compare.t_test(df, ["x"], "g", equal_var=False))
        assert math.isclose(welch.p_value, inference.TTest().tTest(to_java(a), to_java(b)), rel_tol=1e-6)
        pooled = pick(compare.t_test(df, ["x"], "g"))
        assert math.isclose(pooled.statistic, inference.TTest().homoscedasticT(to_java(a), to_java(b)), rel_tol=1e-9)
        ks = pick(compare.ks_test(df, ["x"], "g"))
        assert math.isclose(ks.statistic, inference.KolmogorovSmirnovTest().kolmogorovSmirnovStatistic(to_java(a), to_java(b)), rel_tol=1e-9)
        u = pick(compare.u_test(df, ["x"], "g"))
        both = np.concatenate([a, b])
        assert math.isclose(u.statistic, pd.Series(both).rank()[: len(a)].sum() - len(a) * (len(a) + 1) / 2)
        assert 0 <= u.p_value <= 1
    found = {r.group: r for r in compare.t_test(df, ["x"], "g").collect()}
    assert found["c"]["pass"] and not found["b"]["pass"]


def _array(spark, values_):
    out = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, len(values_))
    for i, v in enumerate(values_):
        out[i] = float(v)
    return out


def test_comparators(arms, spark):
    df, pdf = arms
    sizes = {r.group: r for r in compare.group_sizes(df, "g").collect()}
    assert sizes["b"].control_size == 300 and sizes["b"].test_size_pct == 50
    chi = compare.chi2_test(df, ["c"], "g").collect()
    assert all(r.df == 2 and r.statistic >= 0 for r in chi)
    one = spark.createDataFrame([("a", "p")] * 20 + [("b", "p")] * 20, "g string, c string")
    assert compare.chi2_test(one, ["c"], "g").first().p_value is None
    assert abs(compare.psi(df, ["x"], "g").filter("group = 'b'").first().psi) < 0.2
    smd = compare.smd(df, ["x"], "g").filter("group = 'c'").first().smd
    assert 0.2 < smd < 0.8
    assert compare.mde_by_size(df, ["x"], "g").first().mde > 0
    with pytest.raises(errors.NoColumnsError):
        compare.pairs(df, [], "g")
    with pytest.raises(errors.InvalidArgumentError):
        compare.pairs(df, ["x"], "g", "sideways")


def test_multitest():
    p = [0.01, 0.04, 0.03, None, 0.5]
    new, rejected = multitest.adjust(p, "holm")
    assert np.allclose(new[[0, 1, 2, 4]], [0.04, 0.09, 0.09, 0.5]) and math.isnan(new[3]) and rejected.tolist() == [True, False, False, False, False]
    assert np.allclose(multitest.adjust([0.01, 0.02, 0.03], "fdr_bh")[0], [0.03, 0.03, 0.03])
    assert np.allclose(multitest.adjust([0.01, 0.02, 0.03], "simes-hochberg")[0], [0.03, 0.03, 0.03])
    assert np.allclose(multitest.adjust([0.01, 0.02, 0.022, 0.09], "hommel")[0], [0.03, 0.0440 * 0.75 / 0.75, 0.044, 0.09], atol=0.02)
    raw = np.array([0.001, 0.01, 0.02, 0.2, 0.9])
    for method in multitest.METHODS:
        assert (np.diff(multitest.adjust(raw, method)[0]) >= -1e-12).all()
    for method in set(multitest.METHODS) - {"fdr_tsbh", "fdr_tsbky"}:
        assert (multitest.adjust(raw, method)[0] >= raw - 1e-12).all()
    with pytest.raises(errors.InvalidArgumentError):
        multitest.adjust(raw, "magic")


def test_best_arm_and_sizes():
    strong = pd.DataFrame({"n": [500, 500, 500], "mean": [0.0, 5.0, 0.1], "var": [1.0, 1.0, 1.0]})
    assert multitest.best_arm(strong, iterations=2000) == 2
    assert multitest.best_arm(strong.assign(mean=0.0), iterations=2000) == 0
    assert multitest.min_sample_size([1, 1], 0.1) > multitest.min_sample_size([1, 1], 0.5)
    assert multitest.min_sample_size([1, 4], 0.5, equal_variance=False) > 0


def test_splits(spark):
    df = spark.range(1001).select(F.col("id"), (F.col("id") % 4).alias("s"), F.when(F.col("id") < 10, "control").when(F.col("id") < 20, "x").alias("fixed"))
    count = lambda d: {r.split: r["count"] for r in d.groupBy("split").count().collect()}
    assert count(split.Splitter("id", 1).split(df)) == {"control": 500, "test_1": 501}
    assert count(split.Splitter("id", 1, groups_sizes=(0.2, 0.3, 0.5)).split(df)) == {"control": 200, "test_1": 300, "test_2": 501}
    by = split.Splitter("id", 2, strata=("s",)).split(df).groupBy("s", "split").count().toPandas()
    assert by["count"].between(125, 126).all()
    fixed = split.Splitter("id", 3, const="fixed").split(df)
    assert count(fixed)["control"] == 500 and fixed.filter("id < 10 and split <> 'control'").count() == 0
    assert count(split.Splitter("id", 4, sample_size=0.1).split(df)) == {"control": 50, "test_1": 50, None: 901}
    many = split.split_many(df, "id", [1, 2])
    one = split.Splitter("id", 2).split(df)
    assert many.filter("seed = 2").join(one.select("id", F.col("split").alias("t")), "id").filter("split <> t").count() == 0
    with pytest.raises(errors.InvalidArgumentError):
        split.Splitter("id", groups_sizes=(0.5, 0.6))


def test_batched_splits(spark):
    """Every kind of split in one plan, and the first passing seed as if seeds were tried one by one."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": range(400), "s": rng.integers(0, 3, 400).astype(str), "y": rng.normal(size=400), "fixed": np.where(np.arange(400) < 20, "control", np.where(np.arange(400) < 30, "held", None))})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, s string, y double, fixed string")
    kinds = [{"groups_sizes": (0.2, 0.3, 0.5)}, {"const": "fixed"}, {"sample_size": 0.4}, {"strata": ("s",), "control_size": 0.3}, {"sample_size": 0.3, "groups_sizes": (0.5, 0.25, 0.25)}]
    for kind in kinds:
        many = split.Splitter("id", **kind).split_many(df, [4, 9]).select("id", "seed", "split").toPandas()
        for seed in (4, 9):
            own = split.Splitter("id", seed, **kind).split(df).select("id", "split").toPandas()
            both = own.merge(many[many.seed == seed], on="id")
            assert len(both) == 400 and (both.split_x.fillna("") == both.split_y.fillna("")).all()
    frame = RoleFrame(df, {TargetRole(): ["y"]}, "id")
    seeds = tuple(range(30))
    sampled = {"tests": ("t-test",), "sample_size": 0.2, "reliability": 0.6, "groups_sizes": (0.4, 0.3, 0.3)}
    out = shells.AATest(seeds=seeds, batch=8, **sampled).execute(frame)
    for seed in seeds:
        one = split.Splitter("id", seed, sample_size=0.2, groups_sizes=(0.4, 0.3, 0.3)).split(df).filter("split is not null")
        if not any(r["pass"] for r in compare.t_test(one, ["y"], "split", equal_var=False, reliability=0.6).collect()):
            break
    assert seed > 0 and out.best_seed == seed and {r.seed for r in out.experiments.collect()} == {seed}
    assert {r.split for r in out.best_split.df.select("split").distinct().collect()} == {"control", "test_1", "test_2"}


def test_matching_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(300), "t": rng.integers(0, 2, 300), "x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf["y"] = pdf.x + 2 * pdf.z + 3 * pdf.t
    df = spark.createDataFrame(pdf)
    found = {(r["query"], r["rank"]): r.match for r in matching.match_both(df, "id", "t", ["x", "z"], 2).collect()}
    for i, row in pdf.iterrows():
        other = pdf[pdf.t != row.t]
        d = (other.x - row.x) ** 2 + (other.z - row.z) ** 2
        best = d.sort_values(kind="stable").index[:2]
        assert [found[i, 1], found[i, 2]] == list(best)
    cells = matching.nearest(df.filter("t = 1"), df.filter("t = 0"), "id", ["x", "z"], mode="cells", cells=4, probes=4)
    assert all(found[r["query"], 1] == r.match for r in cells.collect())
    roles = {TreatmentRole(): ["t"], TargetRole(): ["y"], FeatureRole(): ["x", "z"]}
    out = shells.Matching().execute(RoleFrame(df, roles, "id"))
    effect = {r.metric: r for r in out.resume.collect()}
    assert set(effect) == {"ATT", "ATC", "ATE"}
    assert abs(effect["ATE"].effect_size - 3) < 0.3
    low, high = sorted((effect["ATT"].effect_size, effect["ATC"].effect_size))
    assert low - 1e-9 <= effect["ATE"].effect_size <= high + 1e-9
    with pytest.raises(errors.PairsNotFoundError):
        matching.nearest(df, df.limit(0), "id", ["x"])


@pytest.mark.parametrize("k", [1, 3])
def test_tree_search_is_exact(spark, monkeypatch, k):
    """Small cells, crowded and far points, equal points, and cells and queries above a block."""
    monkeypatch.setattr(matching, "CELL", 8)
    monkeypatch.setattr(matching, "WHOLE", 32)
    monkeypatch.setattr(matching, "PART", 16)
    monkeypatch.setattr(matching, "DISTANCES", 256)
    rng = np.random.default_rng(4)
    b = np.round(np.vstack([rng.normal(size=(150, 3)), rng.normal(50, 0.1, (60, 3)), np.ones((50, 3))]), 1)
    q = np.round(np.vstack([rng.normal(size=(60, 3)), rng.normal(30, 20, (20, 3)), np.ones((40, 3))]), 1)
    frame = lambda x, at: spark.createDataFrame([(at + i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    found = matching.nearest(frame(q, 10_000), frame(b, 0), "id", ["x", "y", "z"], k).collect()
    got = {(r["query"] - 10_000, r["rank"]): (r.match, r.d2) for r in found}
    assert len(got) == len(found) == k * len(q)
    for i, v in enumerate(q):
        d2 = ((b - v) ** 2).sum(axis=1)
        for rank, at in enumerate(np.lexsort((np.arange(len(b)), d2))[:k], 1):
            assert got[i, rank][0] == at and abs(got[i, rank][1] - d2[at]) < 1e-9


def test_neighbours_of_equal_distance(spark):
    """The smaller ids, however many candidates are as near; keys may be texts."""
    b = spark.range(3000).select(F.col("id"), F.lit(1.0).alias("x"))
    q = spark.createDataFrame([(9000, 1.0), (9001, 2.0)], "id long, x double")
    for k in (1, 2, 3):
        found = matching.nearest(q, b, "id", ["x"], k).collect()
        assert sorted((r["query"], r["rank"], r.match) for r in found) == [(9000 + i, n + 1, n) for i in range(2) for n in range(k)]
    named = lambda df: df.withColumn("id", F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 5, "0")))
    found = matching.nearest(named(q), named(b), "id", ["x"], 2).collect()
    assert sorted((r["query"], r.match) for r in found) == [("u09000", "u00000"), ("u09000", "u00001"), ("u09001", "u00000"), ("u09001", "u00001")]


def test_pairs_of_the_test_group(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 5.0), (3, 1, 1.5), (4, 1, 9.0)], "id int, t int, x double")
    rows = lambda **o: sorted((r["query"], r.match, r.treated) for r in matching.match_both(df, "id", "t", ["x"], **o).collect())
    assert rows(two_sides=False) == [(3, 1, 1), (4, 2, 1)]
    assert rows(two_sides=False, test_pairs=True) == [(1, 3, 0), (2, 3, 0)]
    assert rows() == [(1, 3, 0), (2, 3, 0), (3, 1, 1), (4, 2, 1)]


def test_match_in_many_groups(spark):
    """2,000 groups are one plan, and each is matched by itself, text keys included."""
    rng = np.random.default_rng(8)
    n = 12_000
    pdf = pd.DataFrame({"id": [f"k{i:05d}" for i in range(n)], "g": np.arange(n) % 2000, "t": (np.arange(n) // 2000) % 2, "x": rng.normal(size=n), "z": rng.normal(size=n)})
    pdf["y"] = pdf.x + 2.0 * pdf.t
    frame = RoleFrame(spark.createDataFrame(pdf), {TreatmentRole(): ["t"], TargetRole(): ["y"], FeatureRole(): ["x", "z"], GroupingRole(): ["g"]}, "id")
    out = shells.Matching(group_match=True, quality_tests=("t-test",)).execute(frame)
    assert out.resume.count() == 6000 and out.resume.select("match_group").distinct().count() == 2000
    assert len(out.resume._jdf.queryExecution().analyzed().toString()) < 20_000
    full = out.full_data.select("id", "g", "x_matched").toPandas()
    assert len(full) == n
    for g in (777, 1999):
        part = pdf[pdf.g == g]
        own = RoleFrame(spark.createDataFrame(part), {TreatmentRole(): ["t"], TargetRole(): ["y"], FeatureRole(): ["x", "z"]}, "id")
        alone = {r.metric: r.effect_size for r in shells.Matching(quality_tests=()).execute(own).resume.collect()}
        there = {r.metric: r.effect_size for r in out.resume.filter(F.col("match_group") == str(g)).collect()}
        assert all(abs(alone[m] - there[m]) < 1e-9 for m in alone)
    assert out.quality.filter("match_group = '5'").count() == 4


def test_cells_find_most_neighbours(spark):
    """Approximate search with far fewer probes than cells, against exact search."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(6000), "x": rng.normal(size=6000), "y": rng.normal(size=6000), "z": rng.normal(size=6000)})
    df = spark.createDataFrame(pdf)
    q, b = df.filter("id % 6 = 0"), df.filter("id % 6 <> 0")
    exact = {r["query"]: r.match for r in matching.nearest(q, b, "id", ["x", "y", "z"]).collect()}
    near = matching.nearest(q, b, "id", ["x", "y", "z"], mode="cells", cells=50, probes=8).collect()
    assert sum(exact[r["query"]] == r.match for r in near) >= 0.9 * len(exact) == 900


def test_matching_options(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(200), "t": rng.integers(0, 2, 200), "x": rng.normal(size=200), "kind": rng.choice(["a", "b", "c"], 200)})
    pdf["y"] = pdf.x + 2.0 * pdf.t
    frame = RoleFrame(spark.createDataFrame(pdf), {TreatmentRole(): ["t"], TargetRole(): ["y"], FeatureRole(): ["x", "kind"]}, "id")
    whole = {r.metric: r.effect_size for r in shells.Matching(bias_estimation=False, quality_tests=()).execute(frame).resume.collect()}
    for metric in ("att", "atc"):
        out = shells.Matching(metric=metric, bias_estimation=False).execute(frame)
        assert [(r.metric, round(r.effect_size, 9)) for r in out.resume.collect()] == [(metric.upper(), round(whole[metric.upper()], 9))]
        assert out.full_data.select("t").distinct().collect() == [(int(metric == "att"),)]
        assert {(r.feature, r.test) for r in out.quality.collect()} == {("x", "t-test"), ("x", "ks-test"), ("kind", "chi2-test")}
    heavy = shells.Matching(weights={"kind": 1e6, "x": 1.0}, quality_tests=()).execute(frame).full_data
    assert heavy.filter("kind <> kind_matched").count() == 0
    plain = shells.Matching(encode_categories=False, quality_tests=()).execute(frame).full_data
    assert plain.filter("kind <> kind_matched").count() > 0
    with pytest.raises(errors.InvalidArgumentError):
        shells.Matching(metric="atx")


def test_skewed_values_spread_over_buckets(spark):
    """Values crowded at one end, in the middle or beside a few far ones; the sums are right and no bucket holds much."""
    from tessera.functions.ranking import cumulative, ordered_bucket

    rng = np.random.default_rng(1)
    for values in (rng.lognormal(0, 3, 20_000), -rng.lognormal(0, 3, 20_000), rng.standard_cauchy(20_000), rng.normal(1e6, 1, 20_000)):
        df = spark.createDataFrame(pd.DataFrame({"v": np.unique(values)})).withColumn("c", F.lit(1))
        span = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        held = df.crossJoin(span).groupBy(ordered_bucket(F.col("v"), F.col("lo"), F.col("hi"))).count().agg(F.max("count")).first()[0]
        assert held < 0.05 * 20_000
        upto = cumulative(df, [], "v", ["c"]).orderBy("v").toPandas()["c__upto"].to_numpy()
        assert (upto == np.arange(1, len(upto) + 1)).all()


def test_positions_of_strings_with_a_common_start(spark):
    from tessera.functions.ranking import position

    df = spark.createDataFrame([(f"user_{i:05d}",) for i in range(500)] + [(None,)], "k string")
    found = {r.k: r.p for r in position(df, "k", "p").collect() if r.k}
    assert all(found[f"user_{i:05d}"] - found["user_00000"] == i for i in range(500))


def test_apply_sees_whole_columns(spark):
    frame = RoleFrame(spark.range(40).select("id", F.col("id").cast("double").alias("x")).repartition(5), {}, "id")
    found = {r.id: r.x for r in frame.apply(lambda s: s - s.mean()).df.collect()}
    assert found == {i: i - 19.5 for i in range(40)}
    with pytest.raises(errors.InvalidArgumentError):
        frame.apply(lambda s: s, most=10)
    with pytest.raises(errors.NotSuitableFieldError):
        prep.one_hot(frame.df.select(F.col("id").cast("string").alias("id")), ["id"], most=10)


def test_correction_is_old_over_new(spark):
    found = multitest.multitest(spark.createDataFrame([(1, 0.0), (2, 0.02), (3, 0.5)], "id int, p_value double"), "bonferroni").collect()
    assert {r.id: round(r.correction, 9) for r in found} == {1: 0.0, 2: round(1 / 3, 9), 3: 0.5}
    arms = pd.DataFrame({"n": [50, 50, 50], "mean": [0.0, 0.5, 0.0], "var": [1.0, 1.0, 1.0]})
    assert multitest.best_arm(arms) == 2 and multitest.best_arm(arms, size="least", alpha=0.001) == 0


def test_variance_reduction(spark):
    df = synthetic.lagged(spark, 3000, seed=4).withColumn("id", F.monotonically_increasing_id())
    adjusted = variance.cuped(df, {"y0": "y0_lag_1"})
    assert variance.variance_reduction(adjusted, {"y0": "y0_cuped"}).first().reduction_pct > 40
    plan = variance.CupacPlan("y0", ("y0_lag_1", "y0_lag_2"), (("X1_lag1",), ("X1_lag2",)))
    out, report = variance.cupac(df, plan, "id", ("linear", "lasso"))
    assert report.model in ("linear", "lasso") and report.reduction_pct["linear"] > 30
    assert variance.variance_reduction(out, {"y0": "y0_cupac"}).first().reduction_pct > 30
    with pytest.raises(errors.NoRequiredArgumentError):
        variance.cupac(df, variance.CupacPlan("y0", (), ((),)), "id")


def test_prep(spark):
    pdf = pd.DataFrame({"k": range(100), "const": 1.0, "x": np.arange(100.0), "x2": np.arange(100.0) * 2, "n": [None] * 90 + [1.0] * 10, "c": ["a"] * 80 + ["b"] * 15 + ["z"] * 5})
    frame = RoleFrame(spark.createDataFrame(pdf), {FeatureRole(): ["const", "x", "x2", "n", "c"]}, "k")
    left = lambda f: set(f.search_columns(FeatureRole)) - set(f.search_columns(AdditionalFeatureRole))
    assert "const" not in left(prep.const_filter()(frame)) and "n" not in left(prep.nan_filter()(frame))
    assert "x" not in left(prep.corr_filter()(frame)) and "x2" in left(prep.corr_filter()(frame))
    assert "const" not in left(prep.cv_filter(lower=0.1)(frame))
    assert prep.category_aggregator(10, "rare")(frame).df.filter("c = 'rare'").count() == 5
    assert prep.outliers_filter()(frame).df.count() == 90
    encoded = prep.dummy_encoder()(frame)
    assert [c for c in encoded.columns if c.startswith("c_")] == ["c_b", "c_z"]
    assert prep.type_caster({int: float})(frame).roles["k"].data_type is float


def test_shells(spark):
    df = synthetic.experiment(spark, 600, nans=False, seed=5).withColumn("const", F.when(F.col("user_id") < 20, "control"))
    roles = {TreatmentRole(): ["treat"], TargetRole(): ["post_spends", "gender"], FeatureRole(): ["age", "industry"], StratificationRole(): ["industry"]}
    frame = RoleFrame(df, roles, "user_id")
    ab = shells.ABTest(tests=("t-test", "chi2-test"), cuped={"post_spends": "pre_spends"}).execute(frame)
    resume = {r.feature: r for r in ab.resume.collect()}
    assert resume["post_spends"]["t-test verdict"] == "OK" and resume["post_spends"].difference > 20
    assert {r.target for r in ab.variance_reduction.collect()} == {"post_spends"}
    homo = shells.HomogeneityTest(("t-test", "chi2-test")).execute(frame).resume.collect()
    assert {r.feature for r in homo} == {"post_spends", "gender"}
    aa = shells.AATest(n_iterations=2, tests=("t-test",), stratification=True).execute(frame)
    assert aa.scores.count() == 2 and aa.best_split.df.groupBy("split").count().count() == 2
    assert set(r.result for r in aa.resume.collect()) <= {"OK", "NOT OK"}
    fixed = shells.AATest(seeds=(1,), tests=("t-test",)).execute(RoleFrame(df, roles | {ConstGroupRole(): ["const"]}, "user_id"))
    assert fixed.best_seed == 1
    grouped = RoleFrame(df, {TreatmentRole(): ["treat"], TargetRole(): ["post_spends"], FeatureRole(): ["age"], GroupingRole(): ["gender"]}, "user_id")
    assert shells.Matching(group_match=True, bias_estimation=False).execute(grouped).resume.count() == 6
    with pytest.raises(errors.NotSuitableFieldError):
        shells.ABTest().execute(RoleFrame(df, {TargetRole(): ["age"]}, "user_id"))


def test_flow(small):
    context = flow.Context(small)
    run = flow.sequence(flow.transform(lambda f: f.with_column("c", F.col("a") * 2)), flow.tabulate("mean/a", lambda c: c.frame["a"].mean().df), flow.when(lambda c: c.has("analysis_tables", "mean/a"), lambda c: c.set_value("variables", "done", True)))
    out = run(context)
    assert out.variables["done"] and out.one_id("mean") == "mean/a" and "c" in out.frame.columns
    assert [r for _, r in flow.over_grid({"a": [1, 2], "b": [3, 4]}, lambda p: p["a"] * p["b"], lambda r: r >= 6)] == [3, 4, 6]
    assert list(flow.by_group(small, "a", len)) == [1, 2, 3]
    with pytest.raises(errors.SpaceError):
        context.set_value("nowhere", "x", 1)
    with pytest.raises(errors.NotFoundInContextError):
        context.one_id("x")


def test_sources(spark, small, tmp_path):
    for kind in ("csv", "parquet", "json", "orc"):
        path = f"{tmp_path}/t.{kind}"
        readers.write_file(small, path)
        assert sorted(r.a for r in readers.read_file(spark, path, key="k").df.collect()) == [1, 2, 3]
    with pytest.raises(errors.InvalidArgumentError):
        readers.read_file(spark, "x.txt")
    assert json.loads(small.to_json())["a"] == [1, 2, 3] and len(small.to_records()) == 3 and small.to_numpy().shape == (3, 3)
    assert RoleFrame.create_empty(spark, {TargetRole(float): ["x"]}).is_empty()
    assert RoleFrame.of(spark, [[1, 2]]).shape == (1, 2) and RoleFrame.of(spark, 3).shape == (1, 1)


def test_synthetic(spark):
    df = synthetic.experiment(spark, 400, seed=1)
    assert df.filter("age is null").count() == 39
    assert synthetic.oracle(spark, 50).filter("TE <> 50 + 100 * X").count() == 0
    assert synthetic.medicine(spark, 50).filter("residual_lifetime < 0").count() == 0
    found = synthetic.control_variates(spark, 3000, dependent=False).groupBy("Treatment").agg(F.avg(F.col("Target") - 100 * F.col("X")).alias("m")).collect()
    assert abs(abs(found[0].m - found[1].m) - 10) < 1e-6
    with pytest.raises(errors.InvalidArgumentError):
        synthetic.set_nans(df, "user_id", [], ["age"])


def test_streaming_moments(spark, tmp_path):
    from tessera.streaming.moments import windowed_moments

    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (F.col("id") % 2).alias("u"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_moments(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), F.col("u"), "v")
    query = stream.writeStream.format("memory").queryName("moments").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    expected = windowed_moments(rows, F.col("u"), "v")
    assert spark.table("moments").exceptAll(expected).count() == 0 and spark.table("moments").count() == expected.count()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_their_sql(spark):
    """A cross-section; the driver compares all of them."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.plans import catalogue

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("group_difference", "ttest_welch", "chi2_stat", "ks_stat", "aa_split_stratified", "cuped_ols", "knn_l2", "ffill", "merge_outer"):
        ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.SQL[name]).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns), name
        a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-6, obj=name)


def test_entry_stands_without_the_optional_operators(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    saved, entry.llm_queries = entry.llm_queries, None
    try:
        assert "group_difference" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    finally:
        entry.llm_queries = saved


@pytest.mark.parametrize("name", ["knn_l2", "match_att_atc_ate", "match_full_data", "match_quality", "bias_correction", "match_group"])
def test_registered_matching_is_exact(spark, monkeypatch, name):
    from tessera.operators import matching
    from tessera.plans import catalogue

    class Asked(Exception):
        pass

    def search(q, b, k, mode, cells, probes):
        raise Asked(mode)

    monkeypatch.setattr(matching, "_search", search)
    with pytest.raises(Asked, match="exact"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["aa_scores", "aa_best_split", "multitest_quantile"])
def test_registered_simulations_take_the_defaults(spark, monkeypatch, name):
    from tessera.plans import catalogue

    class Asked(Exception):
        pass

    def asked(*args, **options):
        raise Asked(sorted(options))

    monkeypatch.setattr(shells, "AATest", asked)
    monkeypatch.setattr(multitest, "best_group", asked)
    with pytest.raises(Asked) as found:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not {"n_iterations", "iterations"} & set(found.value.args[0])


def test_aa_reads_its_table_few_times(spark, monkeypatch):
    """Splits are stored for all tests, and ranges of hashes, not single prefixes, are sent to the rows."""
    seen, saved = spark.sparkContext.accumulator(0), {}
    n = 20_000

    def counted(tables):
        for t in tables:
            seen.add(len(t))
            yield t

    df = spark.range(n).selectExpr("id", "CAST(id % 977 AS DOUBLE) AS y", "CAST(id % 3 AS STRING) AS s").mapInPandas(counted, "id long, y double, s string")
    save = ranking.Workspace.save

    def kept(self, table, name="t"):
        saved[name] = save(self, table, name)
        return saved[name]

    monkeypatch.setattr(ranking.Workspace, "save", kept)
    frame = RoleFrame(df, {StratificationRole(): ["s"], TargetRole(): ["y"]}, "id")
    out = shells.AATest(n_iterations=4, stratification=True, p_values="asymptotic").execute(frame)
    held = out.best_split_statistic.collect()
    assert seen.value <= 6 * n and len(held) == 1
    assert saved["ranges"].count() <= 3 * 3  # the best seed's: control, edge and test of each stratum
    own = {r.id: r.split for r in split.Splitter("id", out.best_seed, strata=("s",)).split(df).select("id", "split").collect()}
    rows = sorted((hashlib.md5(f"{i}:{out.best_seed}".encode()).hexdigest(), i) for i in range(n))
    for s in range(3):
        stratum = [i for _, i in rows if i % 3 == s]
        assert [own[i] for i in stratum] == ["control"] * (len(stratum) // 2) + ["test_1"] * (len(stratum) - len(stratum) // 2)
