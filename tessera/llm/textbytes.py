"""Byte-level NumPy kernels shared by the text operators.

A batch of texts is one UTF-8 buffer with document offsets, taken straight from Arrow, so that
words, hashes and windows are found without a Python object for each of them. Batches are cut
to a few MB at document borders: memory follows the longest document, not the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


class Texts:
    """Consecutive documents: ``data`` holds their bytes, document i is data[at[i]:at[i + 1]]."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The document of each byte position."""
        return np.searchsorted(self.at, positions, side="right") - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def from_arrow(column: pa.Array | pa.ChunkedArray) -> Texts:
    """All texts of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(buffer[at[0] : at[-1]], at - at[0])


def release() -> None:
    """Gives freed memory back to the system, where the allocator can; workers stay small between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(texts: Texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first, last + 1, texts) runs of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(texts.at, texts.at[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        lo, hi = texts.at[i], texts.at[j]
        yield i, j, Texts(texts.data[lo:hi], texts.at[i : j + 1] - lo)
        i = j


def table(*bytes_in: int, start: bool = False) -> np.ndarray:
    """A look-up table over bytes, true for those given."""
    found = np.full(256, start)
    found[list(bytes_in)] = not start
    return found


SPACE = table(0x20, *range(0x09, 0x0E))
NON_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def runs(inside: np.ndarray, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a document's border ends a run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[texts.at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return starts, np.flatnonzero(inside & (~after | border[1:])) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for base, kept in ((_BASE, "_powers"), (_INVERSE, "_inverses")):
            fresh = np.full(size, base, np.uint64)
            fresh[0] = 1
            globals()[kept] = np.multiply.accumulate(fresh)
    return _powers, _inverses


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer from one prefix sum (modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self._inverse = _tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * powers[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spread = (self._sums[ends] - self._sums[starts]) * self._inverse[starts]
        return mix(spread + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of ``size`` bytes, borders ignored."""
        spread = self._sums[size:] - self._sums[:-size]
        spread *= self._inverse[: len(spread)]
        return mix(spread)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n consecutive values."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count])
    return mix(total)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] values, then the next range, and so on."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)
