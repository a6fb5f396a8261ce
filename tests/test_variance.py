"""CUPAC from fold moments, and ordered target statistics."""

import numpy as np
import pandas as pd
import pytest

from tessera import errors
from tessera.operators import variance


def moments(x, y):
    z = np.column_stack([x, y])
    return variance.Moments(float(len(z)), z.mean(axis=0), np.cov(z.T, bias=True))


def test_linear_models():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 3] + 100
    y = x @ [2, 0, 1, -0.5] + rng.normal(size=300)
    m = moments(x, y)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(variance.linear_slopes("linear", m), np.linalg.lstsq(xc, yc, rcond=None)[0])
    assert np.allclose(variance.linear_slopes("ridge", m), np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ yc))
    b = variance.linear_slopes("lasso", m)
    slack = xc.T @ (yc - xc @ b) / len(y)  # at most the penalty, and equal to it in size where a slope stands
    assert (np.abs(slack) <= 1 + 1e-9).all() and np.allclose(slack[b != 0], np.sign(b[b != 0])) and (b == 0).any()
    assert abs(m.left_over(b) - np.var(y - x @ b)) < 1e-9
    halves = variance.Moments.together([moments(x[:100], y[:100]), moments(x[100:], y[100:])])
    assert np.allclose(halves.cov, m.cov) and np.allclose(halves.mean, m.mean)


def test_cupac_takes_few_jobs(spark):
    rng = np.random.default_rng(2)
    n = 500
    lag2 = rng.normal(size=n)
    lag1 = lag2 + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"id": range(n), "y": lag1 + rng.normal(0, 0.3, n), "l1": lag1, "l2": lag2, "x1": rng.normal(size=n), "x2": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else each stage is a job of its own
    spark.sparkContext.setJobGroup("cupac", "cupac")
    out, report = variance.cupac(df, variance.CupacPlan("y", ("l1", "l2"), (("x1",), ("x2",))), "id")
    rows = out.toPandas()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("cupac")
    spark.sparkContext.setJobGroup("", "")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(jobs) <= 3  # moments, mean prediction, result
    assert set(report.reduction_pct) == {"linear", "ridge", "lasso"} and report.model in ("linear", "ridge")
    z = pdf[["x2", "l2"]].to_numpy()
    b = np.linalg.lstsq(np.column_stack([z, np.ones(n)]), pdf.l1, rcond=None)[0]
    guess = pdf[["x1", "l1"]].to_numpy() @ b[:2]
    expected = pdf.y - (guess - guess.mean())
    assert np.abs(rows.set_index("id").loc[range(n), "y_cupac"].to_numpy() - expected).max() < 0.02
    with pytest.raises(errors.InvalidArgumentError):
        variance.cupac(df, variance.CupacPlan("y", ("l1", "l2"), (("x1",), ("x2",))), "id", ("magic",))


def test_target_statistics_do_not_leak(spark):
    """A row's category never carries its own target; categories with one row carry nothing."""
    rng = np.random.default_rng(3)
    n = 300
    pdf = pd.DataFrame({"row": [str(i) for i in range(n)], "hot": np.where(np.arange(n) % 3 == 0, "a", "b"), "own": [f"c{i}" for i in range(n)], "y": rng.normal(size=n)})

    def encoded(frame):
        rows, tables, mean = variance.target_statistics(spark.createDataFrame(frame), "row", ["hot", "own"], "y", ["f", "g"])
        return rows.toPandas().set_index("row"), [t.toPandas().set_index("category")["encoded"] for t in tables], mean

    got, tables, mean = encoded(pdf)
    assert np.allclose(got["g"], mean)
    import hashlib

    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}:target".encode()).hexdigest(), str(i)))
    sums = {"a": [0.0, 0], "b": [0.0, 0]}
    for i in order:
        s = sums[pdf.hot[i]]
        assert abs(got.loc[str(i), "f"] - (s[0] + mean) / (s[1] + 1)) < 1e-9
        s[0], s[1] = s[0] + pdf.y[i], s[1] + 1
    assert all(abs(tables[0][k] - (v[0] + mean) / (v[1] + 1)) < 1e-9 for k, v in sums.items())


def test_text_covariates(spark):
    rng = np.random.default_rng(4)
    n = 600
    kind = rng.choice(["a", "b", "c"], n)
    level = np.select([kind == "a", kind == "b"], [0.0, 5.0], 10.0)
    pdf = pd.DataFrame({"id": range(n), "y": level + rng.normal(size=n), "l1": level + rng.normal(size=n), "l2": level + rng.normal(size=n), "k1": kind, "k2": kind})
    pdf.loc[:4, "k1"] = None
    pdf.loc[5:9, "k1"] = "unseen"
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, y double, l1 double, l2 double, k1 string, k2 string")
    for models in (("linear",), ("boosting",)):
        out, report = variance.cupac(df, variance.CupacPlan("y", ("l1", "l2"), (("k1",), ("k2",))), "id", models)
        rows = out.toPandas().sort_values("id")
        assert len(rows) == n and (rows.y_cupac[:5] == rows.y[:5]).all()
        assert report.reduction_pct[models[0]] > 80 and set(report.importances) == {"k1", "l1"}
        assert rows.y_cupac.var() < 0.3 * rows.y.var()
