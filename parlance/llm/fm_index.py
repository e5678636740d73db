"""FM-index over integer symbols in numpy: suffix array, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of non-negative symbols; a suffix that ends first is the lesser.

    Prefix doubling: the first sort takes as many symbols as fit into 62 bits, and each later round
    sorts only the suffixes that are still tied.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    plus = text.astype(np.int64) + 1
    bits = int(plus.max()).bit_length()
    packed = max(1, min(n, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        key[: n - j] |= plus[j:]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    first = np.flatnonzero(new)
    tied = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
    reach = packed
    while len(tied) and reach < n:
        at = order[tied]
        after = at + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[tied]] = np.maximum.accumulate(np.where(new, tied, 0))
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        reach *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit per level, stably parted into zeros and ones."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        self.levels = max(1, int(seq.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq.astype(np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << level)) != 0
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, dtype=np.int32, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(self.n - ones[-1]))
            cur = np.concatenate((cur[~bit], cur[bit]))

    def _down(self, k: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = self.ones[k][i]
        return np.where(bit == 1, self.zeros[k] + ones, i - ones)

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where prefix length i of the sequence lands, among the symbols equal to symbol."""
        for k in range(self.levels):
            i = self._down(k, (symbol >> (self.levels - 1 - k)) & 1, i)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at i, and where i lands among their equals."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            bit = self.ones[k][i + 1] - self.ones[k][i]
            symbol = symbol << 1 | bit
            i = self._down(k, bit, i)
        return symbol, i


class FMIndex:
    """Counts and places of phrases in a text of symbols from 0; every ``sample``-th position of
    the text is kept, the others are found by steps back through the text."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text
        self.n, self.sigma = len(text), int(text.max()) + 1
        order = suffix_array(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.ranks = WaveletMatrix(text[order - 1])
        self.base = self.ranks.descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        kept = order % sample == 0
        self.sampled = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many phrases of equal length: half-open ranges of suffix ranks."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k].astype(np.int64) + 1
            known = symbol < self.sigma
            high[live[~known]] = low[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            start = self.first[symbol] - self.base[symbol]
            low[live] = start + self.ranks.descend(symbol, low[live])
            high[live] = start + self.ranks.descend(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        rows = rows.astype(np.int64)
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            here = rows[todo]
            hit = self.sampled[here + 1] > self.sampled[here]
            out[todo[hit]] = self.places[self.sampled[here[hit]]] + steps
            todo, here = todo[~hit], here[~hit]
            symbol, at = self.ranks.access(here)
            rows[todo] = self.first[symbol] + at - self.base[symbol]
            steps += 1
        return out
