"""Benchmark decontamination against brute force."""

import random
import re

import pytest

from tessera.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def expected(docs, items):
    tests = {}
    for item, t in items:
        w = words_of(t)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            tests.setdefault(tuple(w[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, t in docs:
        w, hit, found = words_of(t), set(), set()
        for size in {len(x) for x in tests}:
            for i in range(len(w) - size + 1):
                if held := tests.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= held
        out.append((doc_id, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def made(rng):
    say = lambda n, of=40: " ".join(rng.choice(["Alpha", "béta", "ÉTA", "x1", "don't", "gamma,", "delta."]) + str(rng.randrange(of)) for _ in range(n))
    items = [(i, say(rng.randint(10, 40), 400)) for i in range(20)]
    items += [(20, items[3][1]), (21, items[4][1].upper()), (3, say(12, 400)), (None, say(30, 400)), (None, say(11, 400)), (22, None), (23, ""), (24, " ,.;"), (25, "short one"), (26, "lone"), (27, "a b c d e f g h i"), (28, "a a a a a a a a a a a a a"), (29, items[0][1].split()[0])]
    docs = [(i, say(rng.randint(0, 200))) for i in range(30)]
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        cut = rng.randint(0, max(0, len(w) - 10))
        docs.append((100 + i, f"{say(i)} {' ; '.join(w[cut : cut + rng.randint(8, 14)])} {say(20 - i % 9)}"))
    docs += [(200, f"{items[5][1]} {items[6][1]}" * 3), (200, "another text of the same id " + items[7][1]), (None, items[8][1]), (None, None), (201, ""), (202, None), (203, "a " * 40), (204, "é" * 20_000)]
    docs += [(205, say(30_000) + " " + items[9][1] + " " + say(10)), (206, items[1][1])] + [(206, items[1][1])] * 5
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    docs, items = made(random.Random(seed))
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, items string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    found = winnow.contamination(d, b)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, expected(docs, items)))


def test_long_items_only(spark):
    """Every shared run of ten words is found, wherever it stands."""
    rng = random.Random(5)
    run = [f"w{i}" for i in range(10)]
    docs = [(i, " ".join([f"v{rng.randrange(9)}" for _ in range(i % 13)] + run + [f"v{rng.randrange(9)}" for _ in range(i % 7)])) for i in range(60)]
    items = [(i, " ".join([f"u{rng.randrange(9)}" for _ in range(i)] + run + [f"u{rng.randrange(9)}" for _ in range(11 - i)])) for i in range(11)]
    found = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.n_hit, r.n_items) for r in found} == {(10, 11)}


def test_empty_tables(spark):
    docs, items = made(random.Random(7))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not winnow.contamination(d.limit(0), b).collect()
    assert not any(r.contaminated for r in winnow.contamination(d, b.limit(0)).collect())


def test_native(spark):
    docs, items = made(random.Random(7))
    plan = winnow.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
