"""Counts over whole texts, vectorised over a batch."""

from __future__ import annotations

import numpy as np

from .textbytes import LOWER, NON_SPACE, RangeHash, Texts, grams, mix, runs, table

SYMBOLS = table(*b"#*$%&|<>")
UPPER, DIGIT = table(*range(0x41, 0x5B)), table(*range(0x30, 0x3A))
STOP, PUNCTUATION = table(*b".!?"), table(*(b for b in range(0x21, 0x7F) if not chr(b).isalnum()))
CONTINUES = table(*range(0x80, 0xC0))
WIDE = table(*range(0xC0, 0x100))


class Words:
    """Words of a batch: where they start and end, their documents, hashes and sizes."""

    def __init__(self, texts: Texts, inside: np.ndarray = NON_SPACE, fold: bool = False):
        self.texts = texts
        data = LOWER[texts.data] if fold else texts.data
        self.starts, self.ends = runs(inside[data], texts)
        self.bounds = np.searchsorted(self.starts, texts.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.hasher = RangeHash(data)
        self.hashes = self.hasher(self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of n words of one document."""
        hashes = grams(self.hashes, n)
        first = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]) if len(hashes) else np.zeros(0, np.int64)
        return first, hashes[first]


def per_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[texts.at[1:]] - total[texts.at[:-1]]


def distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Different hashes in each of n documents."""
    if not len(doc):
        return np.zeros(n, np.int64)
    keys = mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(doc[first], minlength=n)


def lines(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each line, cut at newlines alone, that holds a word."""
    data = texts.data
    cut = data == 0x0A
    starts, ends = runs(~cut, texts)
    with_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[with_word], ends[with_word]
    return texts.owner(starts), words.hasher(starts, ends)


def base_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    n = len(texts)
    in_word = NON_SPACE[texts.data] & ~CONTINUES[texts.data]
    line_doc, line_hash = lines(texts, words)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_text(in_word, texts),
        "n_symbols": per_text(SYMBOLS[texts.data], texts),
        "n_dup_lines": np.bincount(line_doc, minlength=n) - distinct(line_doc, line_hash, n),
        "n_lines": np.bincount(line_doc, minlength=n),
    }
