"""Suffix arrays by induced sorting, vectorised with NumPy, and permuted common prefixes.

Suffixes are classified as S (smaller than the next suffix) or L; leftmost S positions (LMS)
delimit substrings, which are sorted and named; where names repeat, the string of names is sorted
recursively. From the sorted LMS suffixes the array is induced in linear time, first the L, then
the S suffixes, one byte bucket after the other, each bucket as a few array operations. In the
recursion, whose alphabets are large, suffixes are placed by their symbols up to the next LMS
position and that position's rank, with counting sorts, so that it is linear as well.
"""

from __future__ import annotations

import numpy as np


def _by_keys(*keys: np.ndarray) -> np.ndarray:
    """The order by the last key, then the one before it, and so on, in linear time: a counting sort of each 16 bits.

    Keys are not negative.
    """
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, int(key.max(initial=0)).bit_length(), 16):
            digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]  # NumPy sorts 16-bit integers by radix
    return order


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last symbol is a unique smallest end."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1]).astype(np.int8)
    step[-1] = 1
    settled = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    ahead = np.minimum.accumulate(settled[::-1])[::-1]
    return step[ahead] > 0


def _names(symbols: np.ndarray, bits: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings symbols[start:start + size]; none is a proper prefix of another."""
    per = max(1, 63 // bits)
    rank = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    done = 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for j in range(per):
            at = starts[live] + done + j
            key <<= bits
            inside = done + j < sizes[live]
            key |= np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], 0)
        order = _by_keys(key, rank[live])
        ids = live[order]
        k, r = key[order], rank[ids]
        fresh = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
        if done == 0:
            rank[ids] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        else:  # inside a tied group, whose rank is its first place
            group = np.r_[True, r[1:] != r[:-1]]
            place = np.arange(len(ids)) - np.flatnonzero(group)[np.cumsum(group) - 1]
            rank[ids] = r + place[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        done += per
        tied = ~(fresh & np.r_[fresh[1:], True])
        live = ids[tied & (sizes[ids] > done)]
    return np.unique(rank, return_inverse=True)[1]


def _lms_order(t: np.ndarray, s: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(LMS positions ascending, their ranks)."""
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    symbols = 2 * t.astype(np.int64) + s
    bits = int(2 * alphabet).bit_length()
    names = _names(symbols, bits, lms, np.append(np.diff(lms), 0) + 1)
    count = int(names.max()) + 1 if len(names) else 0
    if count == len(lms):
        return lms, names
    return lms, _ranks(names, count)


def _ranks(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Rank of each suffix of the recursion's string, whose last symbol is the unique smallest."""
    s = _types(t)
    lms, rank = _lms_order(t, s, alphabet)
    n = len(t)
    ahead = np.searchsorted(lms, np.arange(n), side="right")  # the next LMS position
    ahead[-1] = len(lms) - 1  # the end itself
    sizes = lms[ahead] - np.arange(n) + 1
    symbols = 2 * t.astype(np.int64) + s
    names = _names(symbols, int(2 * alphabet).bit_length(), np.arange(n), sizes)
    order = _by_keys(rank[ahead], names)
    out = np.empty(n, np.int64)
    out[order] = np.arange(n)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: uint8 whose last value is the only 0; shorter than 2**31."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    s = _types(t)
    lms, rank = _lms_order(t, s, 256)
    ordered = np.empty(len(lms), np.int32)
    ordered[rank] = lms
    del lms, rank
    counts = np.bincount(t, minlength=256)
    begin = np.cumsum(counts) - counts
    finish = begin + counts
    sa = np.full(n, -1, np.int32)
    lms_bounds = np.searchsorted(t[ordered], np.arange(257))

    def place(entries: np.ndarray, heads: np.ndarray, back: bool) -> None:
        """Puts entries, in the order of the scan, at the heads (or from the tails back) of their buckets."""
        symbol = t[entries]
        by = np.argsort(symbol, kind="stable")
        symbol, entries = symbol[by], entries[by]
        many = np.bincount(symbol, minlength=256)
        first = np.cumsum(many) - many
        nth = np.arange(len(entries)) - first[symbol]
        if back:
            sa[heads[symbol] - 1 - nth] = entries
            heads -= many
        else:
            sa[heads[symbol] + nth] = entries
            heads += many

    head = begin.copy()
    for c in range(256):
        if not counts[c]:
            continue
        parts, done = [], begin[c]
        while done < head[c]:  # L suffixes that this bucket itself induces come behind
            batch = sa[done : head[c]].copy()
            done = head[c]
            parts.append(batch)
            before = batch[batch > 0] - 1
            own = before[(t[before] == c) & ~s[before]]
            sa[head[c] : head[c] + len(own)] = own
            head[c] += len(own)
        parts.append(ordered[lms_bounds[c] : lms_bounds[c + 1]])
        before = np.concatenate(parts)
        before = before[before > 0] - 1
        place(before[(t[before] > c) & ~s[before]], head, back=False)
    tail = finish.copy()
    for c in range(255, -1, -1):
        if not counts[c]:
            continue
        parts, done = [], finish[c]
        while done > tail[c]:
            batch = sa[tail[c] : done][::-1].copy()
            done = tail[c]
            parts.append(batch)
            before = batch[batch > 0] - 1
            own = before[(t[before] == c) & s[before]]
            sa[tail[c] - len(own) : tail[c]] = own[::-1]
            tail[c] -= len(own)
        parts.append(sa[begin[c] : head[c]][::-1])
        before = np.concatenate(parts)
        before = before[before > 0] - 1
        place(before[(t[before] < c) & s[before]], tail, back=True)
    sa[0] = n - 1
    return sa


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(PLCP, predecessor): for each position the suffix before it in the array and their common prefix.

    Only irreducible values, where the preceding symbols differ, are compared; elsewhere the
    value is the left neighbour's less one.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    here = np.arange(n, dtype=np.int32)
    free = np.ones(n, bool)
    free[1:] = (before[1:] <= 0) | (t[:-1] != t[np.maximum(before[1:], 1) - 1])
    free[1:] |= before[:-1] < 0
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    word = np.zeros(n + 1, np.uint64)
    for j in range(8):
        word |= padded[j : n + 1 + j].astype(np.uint64) << np.uint64(8 * j)
    common = np.zeros(n, np.int32)
    a = here[free & (before >= 0)]
    b = before[a]
    origin = a
    while len(a):
        differ = word[a] ^ word[b]
        same = differ == 0
        rest = differ[~same]
        extra = np.zeros(len(rest), np.int32)
        for j in range(1, 8):
            extra += (rest & np.uint64((1 << 8 * j) - 1)) == 0
        common[origin[~same]] += extra
        common[origin[same]] += 8
        origin, a, b = origin[same], a[same] + 8, b[same] + 8
        go = (a < n) & (b < n)
        origin, a, b = origin[go], a[go], b[go]
    last = np.maximum.accumulate(np.where(free, here, 0))
    plcp = np.maximum(common[last] - (here - last), 0)
    plcp[before < 0] = 0
    return plcp, before
