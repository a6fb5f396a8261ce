"""Order statistics and inversions against sorted columns and all pairs."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import prep, selection, stats
from tessera.storage import Workspace


@pytest.mark.parametrize("few", [selection.FEW, 50])
def test_quantiles_by_selection(spark, monkeypatch, few):
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame({"even": rng.normal(size=n), "log": np.exp(rng.normal(0, 9, n)), "same": np.full(n, 7.0), "two": rng.integers(0, 2, n) * 1.0, "far": np.where(np.arange(n) % 500 == 0, 1e300, 1.0 + np.arange(n) * 1e-12), "neg": -np.exp(rng.normal(0, 5, n)), "few": np.where(np.arange(n) < 3, np.arange(n) * 1.0, np.nan)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(4)
    df = df.selectExpr("*", "cast(null as double) AS none")
    qs = [0.0, 0.001, 0.05, 0.5, 0.77, 0.95, 1.0]
    got = stats.quantiles(df, [*pdf.columns, "none"], qs).collect()
    for r in got:
        assert r["none"] is None
        for c in pdf:
            assert np.isclose(r[c], np.quantile(pdf[c].dropna(), r["q"]), rtol=1e-12, atol=0), (c, r["q"])
    kept = prep.drop_outliers(df, ["log", "none"], 0.1, 0.9).count()
    assert kept == ((pdf.log >= pdf.log.quantile(0.1)) & (pdf.log <= pdf.log.quantile(0.9))).sum()


def pairs(x, y, c):
    return sum(c[i] * c[j] for i in range(len(x)) for j in range(len(x)) if x[i] < x[j] and y[i] > y[j])


def test_count_inversions():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 30, 80):
        x, y, c = rng.integers(0, 9, size) * 1.0, rng.normal(size=size).round(1), rng.integers(1, 4, size) * 1.0
        assert selection.count_inversions(x, y, c) == pairs(x, y, c)


@pytest.mark.parametrize("bucket", [10, 40])
def test_inversions_over_buckets(spark, tmp_path, bucket):
    """Buckets of a few cells, values with more cells than a bucket, and coarse cells in several rounds."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=300), np.full(60, 0.5), rng.normal(size=60)].round(3)
    y = np.r_[rng.normal(size=300), rng.normal(size=60), np.full(60, -0.25)].round(3)
    pdf = pd.DataFrame({"x": x, "y": y}).drop_duplicates()
    pdf["c"] = rng.integers(1, 4, len(pdf)) * 1.0
    ws = Workspace(spark, "test")
    got = selection.inversions(ws.save(spark.createDataFrame(pdf)), ws, bucket)
    assert got == pairs(*(pdf[k].to_numpy() for k in ("x", "y", "c")))


def test_bucket_sums_are_sent_to_the_rows(spark):
    """Neither splits nor running sums move the rows to join them with the sums of their buckets."""
    from pyspark.sql import functions as F

    from tessera.functions.ranking import cumulative
    from tessera.operators.split import Splitter

    df = spark.range(200_000).withColumn("g", F.col("id") % 3)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    whole = plan(Splitter("id", 1, strata=("g",)).split(df))
    assert "SortMergeJoin" not in whole and "BroadcastHashJoin" in whole
    edges = [line for line in whole.splitlines() if "Exchange hashpartitioning" in line]
    assert len(edges) == 1  # the rows of prefixes that hold an edge
    sums = plan(cumulative(df.withColumn("c", F.lit(1)), ["g"], "id", ["c"]))
    assert "SortMergeJoin" not in sums and len([x for x in sums.splitlines() if "Exchange hashpartitioning" in x]) == 1


def test_kendall(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 20, 200)
    b = a + rng.integers(0, 15, 200)
    df = spark.createDataFrame([(int(p), int(q), 1, None if p > 10 else 2.0) for p, q in zip(a, b)], "a int, b int, k int, h double")
    found = {(r.column_a, r.column_b): r.value for r in stats.pairwise(df, ["a", "b", "k", "h"], "kendall").collect()}
    s = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i in range(200) for j in range(i))
    ties = lambda v: sum(n * (n - 1) / 2 for n in np.unique(v, return_counts=True)[1])
    total = 200 * 199 / 2
    assert abs(found["a", "b"] - s / np.sqrt((total - ties(a)) * (total - ties(b)))) < 1e-12 and found["b", "a"] == found["a", "b"]
    assert found["a", "a"] == 1 and found["a", "k"] is None and found["a", "h"] is None
