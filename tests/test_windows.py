"""Streams give what tables give, late rows included; user tests and group functions by name."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import errors
from tessera import frame as frame_module
from tessera.frame import RoleFrame
from tessera.operators import compare
from tessera.plans import catalogue, shells
from tessera.roles import FeatureRole, TargetRole, TreatmentRole
from tessera.streaming import windows


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Files in order of arrival: some rows are hours late, a last one moves the watermark on."""
    rng = np.random.default_rng(3)
    n = 400
    seconds = np.sort(rng.integers(0, 10 * 86400, n))
    late = rng.random(n) < 0.2
    arrival = seconds + np.where(late, rng.integers(0, 20 * 3600, n), 0)
    pdf = pd.DataFrame({"s": seconds, "u": rng.integers(0, 6, n), "v": rng.normal(size=n)})
    pdf.loc[::50, "v"] = np.nan
    order = np.argsort(arrival, kind="stable")
    folder = tmp_path_factory.mktemp("events")
    rows = pdf.iloc[order].reset_index(drop=True)
    parts = [*np.array_split(rows, 6), pd.DataFrame({"s": [60 * 86400], "u": [99], "v": [0.0]})]
    made = []
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part.astype(object).where(part.notna(), None), "s long, u long, v double").select(F.timestamp_seconds("s").alias("ts"), "u", "v")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
        made.append(df)
    return folder, made


def streamed(spark, events, make, mode, name, tmp_path):
    """The stream's output with a file a batch; files are moved in one by one so that batches follow their order."""
    import shutil

    folder, made = events
    query = None
    for i in range(len(made)):
        for f in (folder / str(i)).glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            shutil.copy(f, tmp_path / "in" / f"{i}-{f.name}")
        stream = make(spark.readStream.schema(made[0].schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet" if mode == "append" else "memory")
        if mode == "append":
            query = query.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        else:
            query = query.foreachBatch(lambda df, k: df.withColumn("batch", F.lit(int(k))).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").outputMode(mode)
        query = query.trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out")


def everything(made):
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


def rows_of(df):
    return sorted(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("name", ["sliding", "sessions"])
def test_windows_of_streams(spark, events, tmp_path, name):
    make = (lambda e: windows.sliding_moments(e, F.col("u") % 2, "v", window="2 days", slide="12 hours")) if name == "sliding" else (lambda e: windows.sessions(e, F.col("u"), "v", gap="5 hours"))
    got = streamed(spark, events, make, "append", name, tmp_path)
    expected = make(everything(events[1]).filter("u < 99"))
    assert rows_of(got) == rows_of(expected) and expected.count() > 30


def test_sequential_state(spark, events, tmp_path):
    make = lambda e: windows.sequential_test(e.filter("u < 99"), F.lit("all"), F.col("u") % 2 == 1, "v", 0.5)
    got = streamed(spark, events, make, "update", "sequential", tmp_path).orderBy("batch").collect()
    expected = make(everything(events[1])).first()
    last = got[-1]
    assert len(got) == 6 and (last.n0, last.n1) == (expected.n0, expected.n1)
    for c in ("difference", "likelihood_ratio", "p_value"):
        assert abs(last[c] - expected[c]) < 1e-9
    assert last.least_p == min(r.p_value for r in got if r.p_value is not None)


def test_registered_test(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["a"] * 30 + ["b"] * 30 + ["c"] * 30, "x": np.r_[rng.normal(size=60), rng.normal(5, 1, 30)]})
    frame = RoleFrame(spark.createDataFrame(pdf).withColumn("id", F.monotonically_increasing_id()), {TreatmentRole(): ["g"], TargetRole(): ["x"], FeatureRole(): []}, "id")
    compare.register_test("apart", compare.sample_test(lambda a, b: (float(b.min() - a.max()), 0.001 if b.min() > a.max() else 0.5)))
    try:
        out = shells.ABTest(tests=("t-test", "apart")).execute(frame)
        found = {(r["group"], r.test): r for r in out.tests.collect()}
        assert found["b", "apart"].p_value == 0.5 and found["c", "apart"]["pass"] and not found["b", "apart"]["pass"]
        assert out.multitest.filter("test = 'apart'").count() == 2
        aa = shells.AATest(n_iterations=2, tests=("apart",)).execute(RoleFrame(frame.df, {TargetRole(): ["x"]}, "id"))
        assert aa.experiments.count() == 2
        with pytest.raises(errors.InvalidArgumentError):
            compare.register_test("apart", None)
        with pytest.raises(errors.InvalidArgumentError):
            compare.sample_test(lambda a, b: (0, 1), most=10)(frame.df, ["x"], "g")
    finally:
        compare.forget_test("apart")
    with pytest.raises(errors.InvalidArgumentError):
        shells.ABTest(tests=("apart",)).execute(frame)


def test_group_function(spark):
    frame = RoleFrame(spark.createDataFrame([(i, "ab"[i % 2] if i < 8 else None, float(i)) for i in range(10)], "id long, g string, x double"), {}, "id")
    out = frame.apply_groups("g", lambda rows: pd.DataFrame({"g": rows.g.iloc[:1], "top": [rows.x.max()]}), "g string, top double", {TargetRole(): ["top"]}, "g")
    assert {r.g: r.top for r in out.df.collect()} == {"a": 6.0, "b": 7.0} and out.search_columns(TargetRole) == ["top"]
    with pytest.raises(errors.InvalidArgumentError):
        frame.apply_groups("g", lambda rows: rows, "id long, g string, x double", most=3)


def test_group_function_of_parts(spark, monkeypatch):
    """Groups above ``most`` by what a part function keeps, over several parts and tasks."""
    monkeypatch.setattr(frame_module, "PART_ROWS", 100)
    rows = [(i, "abc"[i % 3] if i % 10 else None, float(i * 7919 % 500)) for i in range(3000)]
    frame = RoleFrame(spark.createDataFrame(rows, "id long, g string, x double").repartition(3), {}, "id")
    best = lambda own: own.sort_values(["x", "id"], ascending=[False, True]).head(2)
    expected = sorted((g, i) for g in "abc" for i, _, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:2])
    out = frame.apply_groups("g", lambda own: best(own)[["g", "id"]], "g string, id long", most=200, part=best)
    assert sorted((r.g, r.id) for r in out.df.collect()) == expected
    whole = frame.apply_groups("g", lambda own: pd.DataFrame({"g": own.g.iloc[:1], "n": [len(own)]}), "g string, n long", part=lambda own: own)
    assert {r.g: r.n for r in whole.df.collect()} == {"a": 900, "b": 900, "c": 900}
    with pytest.raises(errors.InvalidArgumentError):
        frame.apply_groups("g", best, "id long, g string, x double", most=200, part=lambda own: own)


def test_dearest_orders_of_large_groups(spark, tmp_path, monkeypatch):
    """The query's groups may be above the rows that one task takes."""
    monkeypatch.setattr(RoleFrame.apply_groups, "__defaults__", tuple(100 if d == 1_000_000 else d for d in RoleFrame.apply_groups.__defaults__))
    orders = spark.range(1000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "CAST(id % 90 AS DOUBLE) AS o_totalprice", "timestamp'2020-01-01' AS o_orderdate", "if(id % 2 = 0, 'high', 'low') AS o_orderpriority", "'O' AS o_orderstatus")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = sorted((r.priority, r.rank, r.price) for r in catalogue.apply_groups(spark, str(tmp_path)).collect())
    assert found == [("high", 1, 88.0), ("high", 2, 88.0), ("high", 3, 88.0), ("low", 1, 89.0), ("low", 2, 89.0), ("low", 3, 89.0)]
