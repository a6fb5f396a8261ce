"""Quality rules from suffix arrays: how much of a text repeats, and how long the longest repeat is.

Each text's suffix array over its words is built for a batch at once by rank doubling (suffixes
of different texts never compare equal). Common prefixes of neighbours come from the ranks of
each doubling. Every interval of the suffix array whose common prefix is at least ``min_words``
is a maximal repeated substring; the union of its occurrences gives the covered words and
characters. A text passes the method's verdict if the covered share of its characters and its
longest repeat stay within the limits.

Defined results: null or blank text has no words, fails the base rule and is not kept; rows,
repeated ones included, are judged by themselves; added columns replace clashing names; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches
from .textbytes import chunks, from_arrow
from .textstats import Words, base_counts


@dataclass(frozen=True)
class RepetitionRules:
    """Limits; shares are of a text's own size."""

    window: int = 8  # words in a repeat that counts
    min_words: int = 20
    max_repeat_percent: int = 30  # base rule: words in repeated windows
    max_covered: float = 0.25  # of the characters of words; long repeated words fail where the base rule counts few
    max_longest: float = 0.15  # longest repeat, of the words: half of what the base rule grants all repeats together
    longest_free: int = 20  # a repeat of so many words never fails by length alone


def suffix_neighbours(tokens: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, positions p in it, common prefix of entries p - 1 and p) where that is >= least.

    tokens: an integer for each word; doc: its text, ascending. Prefixes stop at a text's end.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(doc, doc, side="right")
    order = np.lexsort((tokens, doc))
    fresh = np.r_[True, (tokens[order[1:]] != tokens[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])]

    def first_of_group(fresh: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))

    rank = np.empty(n, np.int64)
    rank[order] = first_of_group(fresh)
    levels, k = [rank.astype(np.int32)], 1
    alone = fresh & np.r_[fresh[1:], True]
    active = np.flatnonzero(~alone)
    seen = None
    while len(active):
        if k >= least and seen is None:
            seen = np.zeros(n, bool)
            seen[active] = True
        i = order[active]
        ahead = i + k
        second = np.where(ahead < end[i], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[i]))
        i, group, second = i[by], rank[i[by]], second[by]
        order[active] = i
        split = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        rank[i] = active[first_of_group(split)]
        levels.append(rank.astype(np.int32))
        k *= 2
        active = active[~(split & np.r_[split[1:], True])]
    if seen is None:
        return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.flatnonzero(seen[1:] & seen[:-1]) + 1
    a, b = order[p - 1].copy(), order[p].copy()
    common = np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks, size = levels[level], 1 << level
        same = (a < end[order[p - 1]]) & (b < end[order[p]])
        same &= ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        common += same * size
        a += same * size
        b += same * size
    keep = common >= least
    return order, p[keep], common[keep]


def repeats(tokens: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered, reach): whether a word lies in a maximal repeat, and the longest repeat from it on."""
    order, p, common = suffix_neighbours(tokens, doc, least)
    reach = np.zeros(len(tokens), np.int64)
    np.maximum.at(reach, order[p], common)
    np.maximum.at(reach, order[p - 1], common)
    steps = np.zeros(len(tokens) + 1, np.int64)
    start = np.flatnonzero(reach)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + reach[start], -1)
    return np.cumsum(steps[:-1]) > 0, reach


def judge(df: DataFrame, rules: RepetitionRules = RepetitionRules(), text: str = "text") -> DataFrame:
    """Adds word counts, base_failed, covered_chars, longest_repeat and kept to each row."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat"]
    new = [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    names = {f.name for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]

    def work(stream):
        for batch in batches(stream):
            parts = []
            for _, _, texts in chunks(from_arrow(batch.column(text))):
                words = Words(texts)
                found = base_counts(texts, words)
                _, tokens = np.unique(words.hashes, return_inverse=True)
                covered, reach = repeats(tokens, words.doc, rules.window)
                n = len(texts)
                chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                size = chars[words.ends] - chars[words.starts]
                found["n_repeat_words"] = np.bincount(words.doc[covered], minlength=n)
                found["covered_chars"] = np.bincount(words.doc, size * covered, minlength=n).astype(np.int64)
                found["longest_repeat"] = np.zeros(n, np.int64)
                np.maximum.at(found["longest_repeat"], words.doc, reach)
                w = found["n_words"]
                failed = (w < rules.min_words) | (100 * found["n_repeat_words"] > rules.max_repeat_percent * w)
                long = found["longest_repeat"] > np.maximum(rules.longest_free, rules.max_longest * w)
                found["base_failed"] = failed
                found["kept"] = ~failed & ~long & (found["covered_chars"] <= rules.max_covered * found["word_chars"])
                parts.append(found)
            columns = [pa.array(np.concatenate([x[f.name] for x in parts])) for f in new]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=[f.name for f in kept + new])

    return df.mapInArrow(work, T.StructType(kept + new))
