"""The search for dense cores compares each row with a bounded number of others."""

import numpy as np

from tessera.llm import forest


def test_products_are_linear(spark, monkeypatch):
    monkeypatch.setattr(forest, "SEEN", 8192)
    products = {}
    for n in (20_000, 80_000):
        rng = np.random.default_rng(n)
        vectors = rng.normal(size=(n, 8))
        centre = rng.normal(size=8)
        vectors[: n // 4] = centre + rng.normal(0, 0.08, (n // 4, 8))
        df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(vectors.tolist())], "cid long, m long, v array<double>").selectExpr("0 AS label", "8 AS dim", "cid", "m", "v").repartition(8)
        held = {}
        save = forest.Workspace.save

        def counted(self, table, name="t"):
            kept = save(self, table, name)
            held[name] = kept.count()
            return kept

        with monkeypatch.context() as m:
            m.setattr(forest.Workspace, "save", counted)
            told, left = forest._cores(df, forest.Workspace(spark, "cores"), 0.93, forest.LEAF, forest.NODE_ROWS)
        products[n] = held["pivots"] * held["sampled"] + held["chosen"] * n
        assert held["sampled"] <= 1.1 * 8192 and held["chosen"] <= forest.CORES
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        core = {r.cid: 0 for r in told.filter("others > 0").collect() if r.cid < n // 4}
        assert len(core) > 0.9 * (n // 4) and left.count() < n - 0.5 * (n // 4)
        some = [r for r in told.groupBy("cid").sum("others").limit(50).collect() if r.cid < n // 4]
        assert all(r["sum(others)"] <= (unit @ unit[r.cid] >= 0.93).sum() - 1 for r in some)
    assert products[80_000] < 6 * products[20_000]


def test_large_components_keep_their_place(spark):
    """Vectors near the largest doubles are projected like others."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 16))
    vectors[300:] = vectors[:300] + rng.normal(0, 0.01, (300, 16))
    rows = [(i, (v * (1e200 if i % 2 else 1e-200)).tolist(), 0) for i, v in enumerate(vectors)]
    found = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), node_rows=100, leaf=32).collect()}
    assert sum(found[i].component_id == found[i + 300].component_id for i in range(300)) >= 270


def test_labels_with_and_without_cores(spark):
    """Two labels above a node of which one alone has dense cores."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(800, 32))
    vectors[:300] = vectors[0] + rng.normal(0, 0.05, (300, 32))
    vectors[500:520] = vectors[400:420] + rng.normal(0, 0.01, (20, 32))
    rows = [(i, v.tolist(), i // 400) for i, v in enumerate(vectors)]
    found = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), node_rows=100, leaf=16).collect()}
    assert len(found) == 800 and all(found[i].component_id == 0 and found[i].n_links == 299 for i in range(300))
    assert sum(found[i].component_id == found[i + 100].component_id == i for i in range(400, 420)) >= 18
    assert all(found[i].n_links == 0 for i in (*range(300, 400), *range(520, 800)))
