"""FM-index over integer sequences: suffix array, Burrows-Wheeler transform in
a wavelet matrix, backward search and location by sampled suffix positions.

All queries are vectorised over many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling (a shorter suffix sorts first)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        if width < n:
            second[:-width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        width *= 2


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        words[:len(packed)] = packed
        self.words = words.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        low = self.words[w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Sequence with access and rank of any symbol, one bit vector per level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            bits, zeros = Bits(ones.astype(np.uint8)), int(len(seq) - ones.sum())
            self.levels.append((bit, bits, zeros))
            seq = np.concatenate((seq[ones == 0], seq[ones == 1]))

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        symbol, lo, hi = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.copy()
        for bit, bits, zeros in self.levels:
            one = bits.get(hi).astype(bool)
            r_lo, r_hi = bits.rank1(lo), bits.rank1(hi)
            lo, hi = np.where(one, zeros + r_lo, lo - r_lo), np.where(one, zeros + r_hi, hi - r_hi)
            symbol |= one.astype(np.int64) << bit
        return symbol, hi - lo

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` entries."""
        lo, hi = np.zeros(len(i), np.int64), i.copy()
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            r_lo, r_hi = bits.rank1(lo), bits.rank1(hi)
            lo, hi = np.where(one, zeros + r_lo, lo - r_lo), np.where(one, zeros + r_hi, hi - r_hi)
        return hi - lo


class FMIndex:
    """Index of a sequence of symbols 1..sigma-1; symbol 0 may serve as a
    boundary that no pattern holds."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate((np.asarray(text, np.int64) + 1, [0]))   # 0: the one end mark
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        self.wavelet = WaveletMatrix(bwt, sigma + 1)
        marked = sa % sample == 0
        self.marked, self.samples = Bits(marked.astype(np.uint8)), sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of patterns (a row each, equal lengths)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for col in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, col].astype(np.int64) + 1
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by stepping back to a sample."""
        row, out, step = row.copy(), np.zeros(len(row), np.int64), 0
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            hit = self.marked.get(r).astype(bool)
            out[live[hit]] = self.samples[self.marked.rank1(r[hit])] + step
            live, r = live[~hit], r[~hit]
            c, before = self.wavelet.access_rank(r)
            row[live] = self.first[c] + before
            step += 1
        return out
