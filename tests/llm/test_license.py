"""Fuzzy notices against edit distances to every part of a text."""

import random

import numpy as np
import pytest

from tessera.llm import license


def distances(notice: bytes, body: bytes) -> np.ndarray:
    """Least edits between the notice and any part of the text that ends at each place."""
    row = np.zeros(len(body) + 1, int)
    for i, c in enumerate(notice, 1):
        last, row = row, np.full(len(body) + 1, i)
        for j, d in enumerate(body, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return row


def whole_distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice("abcxyz ")
        elif kind < 0.7:
            out.insert(at, rng.choice("abcxyz"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pad = lambda: " ".join(rng.choice(["lorem", "ipsum", "general", "public", "notice", "the", "zz"]) for _ in range(rng.randint(0, 6)))
    out = ["mozila public license mozilla public license", "mozilla public license mozila public license", "MIT license, Apache LICENSE", None, "", "x", "all rights reserved" * 3]
    for notice in license.NOTICES:
        for k in (0, 1, notice.errors, notice.errors + 1, notice.errors + 3):
            out.append(f"{pad()} {edited(rng, notice.text.upper() if k % 2 else notice.text, k)} {pad()}")
    out.append("lorem " * 30_000 + license.NOTICES[5].text + " ipsum" * 10)
    return [(i, t) for i, t in enumerate(out)] + [(0, out[0]), (0, out[0]), (None, out[1])]


def test_fuzzy_labels_and_spans(spark, texts):
    rows = license.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    by_label = {}
    for n in license.NOTICES:
        by_label.setdefault(n.label, []).append(n)
    for r in rows:
        body = (r.text or "").encode()
        folded = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\n\x0b\x0c\r" else c for c in body)
        base = set(r.base_labels.split(",")) - {""}
        if len(body) < 2000:
            found = {label for label, notices in by_label.items() if any(distances(n.text.encode(), folded).min() <= n.errors for n in notices)}
            assert set(r.labels.split(",")) - {""} == base | found, r.text
        for s in r.spans:
            part = folded[s.start : s.end]
            assert any(whole_distance(n.text.encode(), part) <= s.errors <= n.errors for n in by_label[s.label])
    neighbours = [r for r in rows if r.text and r.text.startswith(("mozila", "mozilla"))]
    assert len(neighbours) == 5 and all(len([s for s in r.spans if s.label == "mpl"]) == 2 for r in neighbours)
    assert any(s.label == "mit" for r in rows if r.text and len(r.text) > 100_000 for s in r.spans)


def test_empty_table(spark):
    assert not license.scan(spark.createDataFrame([], "doc_id long, text string")).collect()
