"""Dictionaries, verdict tables, copies with other parameters, and splitters from their ids."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera.frame import RoleFrame
from tessera.operators.split import Splitter
from tessera.plans import reports, shells
from tessera.roles import FeatureRole, TargetRole, TreatmentRole


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    n = 240
    pdf = pd.DataFrame({"id": range(n), "t": np.arange(n) % 2, "x": rng.normal(size=n), "c": rng.choice(["p", "q"], n)})
    pdf["y"] = pdf.x + 3.0 * pdf.t
    return RoleFrame(spark.createDataFrame(pdf), {TreatmentRole(): ["t"], TargetRole(): ["y", "c"], FeatureRole(): ["x"]}, "id")


def test_reports_of_tests(frame):
    out = shells.ABTest(tests=("t-test", "ks-test", "chi2-test")).execute(frame)
    flat = reports.as_dict(out)
    assert flat["y t-test pass 1"] is True and flat["y t-test p-value 1"] < 1e-6
    assert abs(flat["y group-difference difference 1"] - 3) < 0.5 and flat["group-sizes control size 1"] == 120
    deep = reports.nested(out)
    assert set(deep["y"]["1"]) == {"t-test", "ks-test", "group-difference"} and "p-value" in deep["c"]["1"]["chi2-test"]
    table = {r.feature: r for r in reports.verdicts(out.tests, True).collect()}
    assert table["y"]["t-test pass"] == "OK" and table["c"]["t-test pass"] is None and table["c"]["chi2-test p-value"] is not None
    homogeneous = shells.HomogeneityTest(tests=("t-test",)).execute(frame)
    assert {r.feature: r["t-test pass"] for r in reports.verdicts(homogeneous.tests).collect()} == {"y": "NOT OK"}


def test_reports_of_splits_and_matches(spark, frame):
    plain = RoleFrame(frame.df.select("id", "y"), {TargetRole(): ["y"]}, "id")
    out = shells.AATest(n_iterations=4, tests=("t-test",)).execute(plain)
    flat = reports.as_dict(out)
    assert flat["best seed"] == out.best_seed and "y t-test p-value test_1" in flat and "y group-difference difference test_1" in flat
    row = reports.aa_summary(out.experiments).first()
    assert row.n_splits == 4 and 0 <= row.passed_share <= 1
    matched = shells.Matching(bias_estimation=False).execute(RoleFrame(frame.df.drop("c"), {TreatmentRole(): ["t"], TargetRole(): ["y"], FeatureRole(): ["x"]}, "id"))
    flat = reports.as_dict(matched)
    assert abs(flat["y ATE effect size"] - 3) < 0.5 and "x t-test p-value 1" in flat


def test_parameters_and_ids(spark):
    test = shells.ABTest()
    assert reports.configured(test, {"equal_var": True, shells.AATest: {"batch": 3}, shells.ABTest: {"reliability": 0.1}}) == shells.ABTest(equal_var=True, reliability=0.1)
    with pytest.raises(errors.InvalidArgumentError):
        reports.configured(test, {"magic": 1})
    df = spark.range(200).withColumn("s", F.col("id") % 3)
    for made in (Splitter("id", 3), Splitter("id", 4, groups_sizes=(0.2, 0.3, 0.5), strata=("s",)), Splitter("id", sample_size=0.5)):
        again = Splitter.from_id(made.id)
        assert again == made and again.split(df).exceptAll(made.split(df)).count() == 0
    with pytest.raises(errors.InvalidArgumentError):
        Splitter.from_id("magic")
