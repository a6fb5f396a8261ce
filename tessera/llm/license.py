"""License scans: exact phrases by words, and short notices with a bounded number of errors.

Exact: places where a phrase's words stand consecutively, found by word hashes over a batch.
Fuzzy: a notice that may have k errors is split into k + 1 seeds, one of which any match holds
unchanged. Seeds are searched in the lower-cased bytes; around each hit the regex library
verifies the whole notice with at most k insertions, deletions or substitutions and gives the
span and its errors.

Defined results: null text counts as empty: no words, no labels, score 0; rows, repeated ones
included, are scanned by themselves; added columns replace clashing names; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches
from .textbytes import LOWER, SPACE, RangeHash, Texts, chunks, from_arrow, grams, table
from .textstats import Words

WORD = table(*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))

#: Fixed values of the query's contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int


NOTICES = (
    Notice("licensed under the gnu general public license", "gpl", 4),
    Notice("this program is free software: you can redistribute it", "gpl", 4),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("licensed under the apache license, version 2.0", "apache", 4),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted, free of charge, to any person", "mit", 5),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under cc by-nc 4.0", "cc-by-nc", 2),
    Notice("licensed under cc by-sa 4.0", "cc-by-sa", 1),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("all rights reserved", "all-rights-reserved", 1),
    Notice("released into the public domain", "public-domain", 3),
)


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: tuple[Notice, ...]):
        import regex

        self.phrases = []
        for phrase, label in phrases.items():
            words = [np.frombuffer(w.encode(), np.uint8) for w in phrase.split()]
            hashes = np.array([RangeHash(w)(np.array([0]), np.array([len(w)]))[0] for w in words], np.uint64)
            self.phrases.append((grams(hashes, len(words))[0], len(words), label))
        self.notices = []
        for notice in notices:
            raw = notice.text.encode()
            cuts = np.linspace(0, len(raw), notice.errors + 2).astype(int)
            seeds = [(raw[a:b], int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            # the first match, made better where it stands: the best one of a window would hide those before it
            pattern = regex.compile(b"(?e)(?:" + regex.escape(notice.text).encode() + b"){e<=%d}" % notice.errors)
            self.notices.append((notice, len(raw), seeds, pattern))

    def exact(self, words: Words) -> list[tuple[np.ndarray, np.ndarray, str]]:
        """(document, first word in it, label) of all places."""
        found, by_size = [], {}
        for target, size, label in self.phrases:
            if size not in by_size:
                by_size[size] = words.grams(size)
            first, hashes = by_size[size]
            at = first[hashes == target]
            doc = words.doc[at]
            found.append((doc, at - words.bounds[doc], label))
        return found

    def fuzzy(self, texts: Texts, lowered: bytes) -> list[tuple[int, int, int, str, int, float]]:
        """(document, start, end, label, errors, score): spans in bytes of their document."""
        out = []
        for notice, size, seeds, pattern in self.notices:
            k = notice.errors
            windows = []
            for seed, offset in seeds:
                at = lowered.find(seed)
                while at >= 0:
                    windows.append((at - offset - k, at - offset + size + k))
                    at = lowered.find(seed, at + 1)
            if not windows:
                continue
            windows = np.array(sorted(windows))
            near = np.r_[True, windows[1:, 0] > np.maximum.accumulate(windows[:, 1])[:-1]]
            group = np.cumsum(near) - 1
            lo = windows[near, 0]
            hi = np.zeros(len(lo), np.int64)
            np.maximum.at(hi, group, windows[:, 1])
            for a, b in zip(np.maximum(lo, 0).tolist(), np.minimum(hi, len(lowered)).tolist(), strict=True):
                first, last = (int(x) for x in texts.owner(np.array([a, max(a, b - 1)])))
                for doc in range(first, last + 1):
                    x, y = max(a, int(texts.at[doc])), min(b, int(texts.at[doc + 1]))
                    for m in pattern.finditer(lowered, x, y):
                        errors = sum(m.fuzzy_counts)
                        out.append((doc, m.start() - int(texts.at[doc]), m.end() - int(texts.at[doc]), notice.label, errors, 1 - errors / size))
        return out


@functools.cache
def _scanner(phrases: tuple, notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(dict(phrases), notices)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("errors", T.IntegerType())])


def scan(df: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and spans (of bytes)."""
    own = tuple((PHRASES if phrases is None else phrases).items())
    long, string = T.LongType(), T.StringType()
    new = [T.StructField(n, t) for n, t in (("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", string), ("labels", string), ("score", T.DoubleType()), ("spans", T.ArrayType(SPAN)))]
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int32())]))

    def work(stream):
        scanner = _scanner(own, notices)
        for batch in batches(stream):
            rows: list[dict] = []
            for _, _, texts in chunks(from_arrow(batch.column(text))):
                words = Words(texts, WORD, fold=True)
                found = [{"n_words": n, "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []} for n in words.counts.tolist()]
                for docs, firsts, label in scanner.exact(words):
                    for d, w in zip(docs.tolist(), firsts.tolist(), strict=True):
                        x = found[d]
                        x["n_base"] += 1
                        x["first_word"] = w if x["first_word"] is None else min(w, x["first_word"])
                        x["last_word"] = w if x["last_word"] is None else max(w, x["last_word"])
                        x["base"].add(label)
                        x["score"] = 1.0
                lowered = LOWER[texts.data]
                lowered[SPACE[lowered]] = 0x20
                for d, a, b, label, errors, score in scanner.fuzzy(texts, lowered.tobytes()):
                    x = found[d]
                    x["labels"].add(label)
                    x["score"] = max(x["score"], score)
                    x["spans"].append({"start": a, "end": b, "label": label, "errors": errors})
                rows += found
            for x in rows:
                x["base_labels"] = ",".join(sorted(x["base"]))
                x["labels"] = ",".join(sorted(x["labels"] | x["base"]))
                x["spans"].sort(key=lambda s: (s["start"], s["end"], s["label"]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans_type]
            arrays = [pa.array([x[f.name] for x in rows], t) for f, t in zip(new, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + arrays, names=[f.name for f in kept + new])

    return df.mapInArrow(work, T.StructType(kept + new))
