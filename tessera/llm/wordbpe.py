"""Ids of a tokenizers word-BPE file for whole texts.

The file's own Tokenizer encodes everything but plain words: runs of ASCII letters, which its
normalisers only lower-case and its pre-tokenizer never joins to a neighbour. Those, nearly all
distinct words, are merged for a whole batch at once: in each round every word joins its
leftmost pair of lowest rank, which is the order in which the merges are defined. Strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from .textbytes import LOWER, ranges
from .units import Encoded

_PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordBPE:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = f.read()
        self._tokenizer = Tokenizer.from_str(made)
        self._tokenizer.encode_special_tokens = True
        model = json.loads(made)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self._inner, self._last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c in range(0x61, 0x7B):
            self._inner[c], self._last[c] = vocab[chr(c)], vocab[chr(c) + end]
        self._n = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self._n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0]
        self._keys, self._ranks = keys[order][first], order[first]
        self._made = made  # by rank
        self._none = len(pairs)
        self._tails: dict[bytes, list[int]] = {}

    def other(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of words of ASCII letters."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = LOWER[np.frombuffer(b"".join(words), np.uint8)]
        symbols = self._inner[letters]
        last = np.cumsum(sizes) - 1
        symbols[last] = self._last[letters[last]]
        out = np.zeros(len(symbols), np.int64)
        home = np.cumsum(sizes) - sizes  # where a word's ids go in out
        final = np.zeros(len(words), np.int64)
        live, owner = np.arange(len(words)), np.repeat(np.arange(len(words)), sizes)
        while len(live):
            bound = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            keys = symbols[:-1] * self._n + symbols[1:]
            found = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
            rank = np.where((self._keys[found] == keys) & (owner[1:] == owner[:-1]), self._ranks[found], self._none)
            rank = np.append(rank, self._none)
            best = np.minimum.reduceat(rank, bound)
            count = np.diff(np.append(bound, len(symbols)))
            done = best == self._none
            if done.any():
                to = ranges(home[live[done]], count[done])
                out[to] = symbols[ranges(bound[done], count[done])]
                final[live[done]] = count[done]
                keep = np.repeat(~done, count)
                symbols, owner, rank, live, best = symbols[keep], owner[keep], rank[keep], live[~done], best[~done]
                if not len(live):
                    break
                count = count[~done]
            hit = np.flatnonzero(rank == np.repeat(best, count))
            hit = hit[np.r_[True, owner[hit[1:]] != owner[hit[:-1]]]]
            symbols[hit] = self._made[best]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out[ranges(home, final)], final

    def encode_units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        stems: dict[bytes, int] = {}
        rest: list[bytes] = []
        plan = []
        for w in words:
            if m := _PLAIN.match(w):
                plan.append((stems.setdefault(m[1].lower(), len(stems)), m[2]))
            else:
                plan.append((None, w))
                rest.append(w)
        tails = list({t for s, t in plan if s is not None and t} - self._tails.keys())
        if len(self._tails) > 50_000:
            self._tails.clear()
            tails = list({t for s, t in plan if s is not None and t})
        self._tails.update(zip(tails, self.other(tails), strict=True))
        flat, sizes = self.plain(list(stems)) if stems else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.cumsum(sizes).tolist()
        starts = [0, *ends[:-1]] if ends else []
        flat = flat.tolist()
        others = iter(self.other(rest))
        ids: list[int] = []
        counts = []
        for s, t in plan:
            before = len(ids)
            if s is None:
                ids += next(others)
            else:
                ids += flat[starts[s] : ends[s]]
                if t:
                    ids += self._tails[t]
            counts.append(len(ids) - before)
        return np.array(ids, np.uint32), np.array(counts, np.int64)


@functools.cache
def cached_units(path: str) -> Encoded:
    """The worker's units for one file."""
    return Encoded(WordBPE(path).encode_units)
