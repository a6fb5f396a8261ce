"""Tokenising by distinct units.

Texts are cut where no token of the given tokenizer can cross, each distinct unit is encoded
once for each Python worker, and ids are gathered with NumPy. The cache is only a cache, held in
sorted arrays: it is emptied when it holds ``LIMIT`` units.
"""

from __future__ import annotations

import numpy as np

from .textbytes import NON_SPACE, SPACE, RangeHash, Texts, ranges, runs

LIMIT = 600_000


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Runs without ASCII white space."""
    return runs(NON_SPACE[texts.data], texts)


def spaced_words(texts: Texts, before: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """White space with the run that follows it; together they cover every byte.

    A cut stands before a byte of ``before`` (ASCII white space) whose predecessor is no white
    space. Where the predecessor may end a wider Unicode space, no cut is made.
    """
    data, n = texts.data, len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    control = data < 0x20
    last, last2, last3 = (np.concatenate([np.zeros(k, np.uint8), data[:-k]])[:n] for k in (1, 2, 3))
    wide = (last2 == 0xC2) & ((last == 0x85) | (last == 0xA0))
    wide |= (last3 >= 0xE1) & (last3 <= 0xE3) & ((last2 == 0x80) | (last2 == 0x81) | (last2 == 0x9A))
    cut = before[data] & ~wide
    cut[1:] &= ~space[:-1] & ~control[:-1]
    cut[0] = True
    inner = texts.at[(texts.at < n)]
    cut[inner] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)


class Encoded:
    """Ids of units: unit u has flat[at[u]:at[u + 1]]."""

    limit = LIMIT

    def __init__(self, encode):
        self._encode = encode
        self._clear()

    def _clear(self) -> None:
        self._known, self._slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def slots(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each unit; unknown ones are encoded first."""
        hashes = RangeHash(texts.data)(starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._slot) + len(distinct) > self.limit:
            self._clear()
        found = np.full(len(distinct), -1, np.int64)
        if len(self._known):
            place = np.minimum(np.searchsorted(self._known, distinct), len(self._known) - 1)
            found = np.where(self._known[place] == distinct, self._slot[place].astype(np.int64), -1)
        if len(new := np.flatnonzero(found < 0)):
            view = texts.data.tobytes()
            pieces = [view[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            flat, sizes = self._encode(pieces)
            base = len(self.at) - 1
            slots = np.arange(base, base + len(new))
            found[new] = slots
            known = np.concatenate([self._known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self._known, self._slot = known[order], np.concatenate([self._slot, slots.astype(np.int32)])[order]
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self._added(pieces, slots)
        return found[inverse]

    def _added(self, pieces: list[bytes], slots: np.ndarray) -> None:
        """For subclasses that keep more than ids."""

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has."""
        sizes = self.at[slots + 1] - self.at[slots]
        return self.flat[ranges(self.at[slots], sizes)], sizes
