"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def expected(rows):
    """Output rows by comparing every anchor with every other row."""
    whole = []
    for vec_id, v, label, _ in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        whole.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, q))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, q) in enumerate(whole):
        if anchor is None or anchor % 100:
            continue
        score = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, other[2], strict=True)))), other[0], other[1]) for j, other in enumerate(whole) if j != i and len(other[2]) == len(q)]
        for ps, positive, _ in sorted([s for s in score if s[2] == label], key=order)[:5]:
            held = sorted([s for s in score if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps], key=order)[:5]
            out += [(anchor, positive, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(held)]
    return out


def compare(spark, rows, **options):
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected(rows)))
    return found


@pytest.mark.parametrize("block", [negatives.ROWS, 16 * 40])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(4)
    mean = rng.normal(size=16)
    rows = [(i * 5, (mean + rng.normal(size=16)).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3])), "clash") for i in range(500)]
    rows += [(10_000 + i, rows[i % 3][1], i % 3, "") for i in range(60)]  # ties
    rows += [(100, rows[5][1], 1, ""), (100, rows[5][1], 1, ""), (7, rows[9][1], 9, ""), (None, rows[0][1], 0, ""), (None, rows[0][1], 1, "")]
    rows += [(700, None, 1, ""), (800, [1.0] * 15 + [float("nan")], 1, ""), (900, [1.0] * 15 + [None], 1, ""), (1000, rows[1][1], None, ""), (1100, [], 1, ""), (20_000, [1.0, 2.0], 1, ""), (20_001, [1.0, 2.0], 1, ""), (20_002, [1.0, 1.5], 2, "")]
    rows += [(30_000, [0.0] * 16, 4, ""), (30_001, [0.0] * 16, 4, ""), (40_000, [-1.0] * 16, 5, ""), (40_001, [1.0] * 16, 5, "")]
    assert len(compare(spark, rows, block=block)) > 100


def test_huge_components(spark):
    rows = [(i * 50, [float(x) for x in v], i % 2, "") for i, v in enumerate([[3e38, 1], [3e38, 2], [1e20, 1], [1e9, 3], [1, 1], [-3e38, 1], [2e9, 2e9], [2e9, 1.9e9]])]
    compare(spark, rows)


def test_pairs_are_discarded():
    """With one strong direction, bounds leave few pairs to verify."""
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(20_000, 32)) * np.geomspace(1, 0.01, 32))
    rows = rows @ np.eye(32)[rng.permutation(32)]
    anchors = rows[:50]
    ids = np.arange(len(rows))
    least, most = np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62)
    every = lambda i, j: np.ones(len(i), bool)
    (slot, score, found, _), verified = negatives.search(anchors, rows, ids, least, most, every, 5, negatives.axes(rows[:2000]))
    whole = (anchors @ rows.T).astype(np.int64)
    assert all(sorted(score[slot == i].tolist(), reverse=True) == np.sort(whole[i])[::-1][:5].tolist() for i in range(50))
    assert verified < 0.1 * len(anchors) * len(rows)


def test_empty_table(spark):
    assert not negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect()
