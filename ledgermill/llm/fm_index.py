"""FM-index over a sequence of small integers, in numpy.

The suffix array comes from prefix doubling that sorts only what is still
tied. The last column of the sorted rotations is kept as a wavelet matrix of
packed bit vectors with a running count per 64 bits; every ``SAMPLE``-th text
position keeps its suffix position. All queries work on arrays of patterns.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a text whose last symbol occurs once and is the smallest."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    # a suffix has the number of the first place of its group of equals
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        at = order[tied]
        key = rank[at] * np.int64(n + 1) + np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1) + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        new[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        h *= 2


class _Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Counts of a symbol before a place, and the symbol at a place."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append((level, _Bits(bits), int((~bits).sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        low = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level, bits, zeros in self.levels:
            one = (symbol >> level & 1).astype(bool)
            a, b = bits.ones(low), bits.ones(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before its place."""
        symbol = np.zeros(len(i), np.int64)
        low = np.zeros(len(i), np.int64)
        i = i.astype(np.int64)
        for level, bits, zeros in self.levels:
            one = bits.get(i)
            symbol |= one.astype(np.int64) << level
            # the block of equal symbols starts where its first one would be
            a, b = bits.ones(low), bits.ones(i)
            low = np.where(one, zeros + a, low - a)
            i = np.where(one, zeros + b, i - b)
        return symbol, i - low


class FMIndex:
    """Finds all places of patterns in a text of symbols ``1 .. sigma - 1``."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.n, self.sigma = len(text), sigma
        self.wavelet = WaveletMatrix(last, sigma)
        counts = np.bincount(text, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = _Bits(order % sample == 0)
        self.positions = order[order % sample == 0]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns, read from their ends."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for j in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, j]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back to the next sampled one, counting the steps."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled.get(rows))
        while len(open_):
            symbol, before = self.wavelet.access(rows[open_])
            rows[open_] = self.before[symbol] + before
            steps[open_] += 1
            open_ = open_[~self.sampled.get(rows[open_])]
        return self.positions[self.sampled.ones(rows)] + steps
