"""Suffix-array dedup of rows that are equal in id and text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup


def body(rng):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))


@pytest.mark.parametrize("passage", [None, 256])
def test_equal_rows(spark, passage):
    """2,000 equal rows, and 2,000 equal ones without id, take no longer than 2,000 distinct ids."""
    rng = random.Random(4)
    same, other, shared = body(rng), body(rng), body(rng)[:900]
    lone = [(i, f"{body(rng)} {shared if i < 12 else ''} {body(rng)}") for i in range(10, 14)]

    def run(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.time()
        found = suffix_dedup.dedup_suffixes(df, passage=passage).select("doc_id", "n_bytes", "n_removed", F.length("kept").alias("left")).collect()
        return found, time.time() - began

    run(lone)
    distinct, took = run([(100 + i, same if i % 2 else other) for i in range(4000)] + lone)
    equal, again = run([(1, same)] * 2000 + [(None, other)] * 2000 + lone)
    for rows in (distinct, equal):
        copies = [r for r in rows if r.doc_id is None or r.doc_id not in range(10, 14)]
        assert len(copies) == 4000 and all(r.n_removed == r.n_bytes and not r.left for r in copies)
        gone = dict((r.doc_id, r.n_removed) for r in rows if r.doc_id in range(10, 14))
        assert gone[10] == gone[11] in range(900, 910) and gone[12] == gone[13] == 0  # what stands around it can be equal too
    assert again < 2 * took + 10


def test_two_texts_of_one_id(spark):
    rng = random.Random(5)
    same, other = body(rng), body(rng)
    rows = [(1, same), (1, same), (1, other), (2, other[:390]), (3, None), (3, None), (4, ""), (4, "")]
    found = suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in found) == sorted((i, len(t or ""), len(t) if t is same else 0) for i, t in rows)
