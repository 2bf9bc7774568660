"""Compressed FM-index over words: suffix order, wavelet matrix, backward search in step."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes of a symbol sequence with counts per 64 bits; answers rank for many places at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        current = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = ((current >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(bits) - int(bits.sum()))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        self.base = self._map(np.arange(size), np.zeros(size, np.int64))

    def _map(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.copy()
        for k in range(self.levels):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            masked = self.words[k][block] & ((np.uint64(1) << inside) - np.uint64(1))
            ones = self.counts[k][block] + np.bitwise_count(masked)
            bit = (symbols >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._map(symbols, at) - self.base[symbols]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by doubling, and ranks by the first ``depth`` symbols (a power of two)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    at_depth, k, order = rank, 1, np.argsort(rank, kind="stable")
    while True:
        follow = np.zeros(n, np.int64)
        if k < n:
            follow[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        ranks = np.cumsum(fresh)
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        k *= 2
        if k <= depth:
            at_depth = rank
        if k >= depth and ranks[-1] == n - 1 or k >= 2 * n:
            return order, at_depth


class FmIndex:
    """Index of word sequences. Sequences are parted by signs of their own, so no match crosses them."""

    DEPTH = 32

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        if not self.DEPTH < window <= 2 * self.DEPTH:
            raise ValueError(f"windows of {self.DEPTH + 1} to {2 * self.DEPTH} words")
        self.window, self.lengths = window, np.array([len(s) for s in sequences])
        count = len(sequences)
        flat = np.concatenate(sequences)
        words = np.unique(flat, return_inverse=True)[1] + count
        ends = np.cumsum(self.lengths + 1)
        self.starts = ends - self.lengths - 1
        text = np.empty(int(ends[-1]), np.int64)
        text[ends - 1] = np.arange(count)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] = words
        self.text, self.size = text, int(text.max()) + 1
        order, ranks = suffix_order(text, self.DEPTH)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.wavelet = WaveletMatrix(text[order - 1], self.size)
        # runs of suffixes that share their first ``window`` words, and the least owner of each
        padded = np.append(ranks, np.full(window, -1))
        shift = window - self.DEPTH
        same = (padded[order][1:] == padded[order][:-1]) & (padded[order + shift][1:] == padded[order + shift][:-1])
        first = np.append(True, ~same)
        self.run_of = np.cumsum(first) - 1
        self.run_start = np.append(np.flatnonzero(first), len(text))
        owner = np.repeat(owners, self.lengths + 1)
        self.least_owner = np.minimum.reduceat(owner[order], self.run_start[:-1])

    def least_owners(self, which: np.ndarray) -> list[np.ndarray]:
        """For sequences of the index, the least owner of every window, by backward search.

        All sequences go one word to the left per step; matches longer than the window are
        cut back to the run of suffixes that share its words.
        """
        out = [np.empty(max(0, n - self.window + 1), np.int64) for n in self.lengths[which]]
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.text))
        for step in range(1, int(self.lengths[which].max(initial=0)) + 1):
            live = np.flatnonzero(self.lengths[which] >= step)
            place = self.lengths[which[live]] - step
            symbol = self.text[self.starts[which[live]] + place]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            if step >= self.window:
                run = self.run_of[low[live]]
                low[live], high[live] = self.run_start[run], self.run_start[run + 1]
                least = self.least_owner[run]
                for k, p, value in zip(live.tolist(), place.tolist(), least.tolist(), strict=True):
                    out[k][p] = value
        return out
