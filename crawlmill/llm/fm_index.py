"""A compressed full-text index (FM-index) over sequences of numbers, for patterns of bounded length."""

from __future__ import annotations

import numpy as np


class BitRanks:
    """A packed bit vector with ranks: one count per 64 bits, and popcounts inside."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64)
        packed = np.zeros(n * 8, np.uint8)
        data = np.packbits(bits, bitorder="little")
        packed[: len(data)] = data
        self.words = packed.view(np.uint64)
        self.before = np.zeros(n, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol, highest first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(int(sigma - 1).bit_length(), 1)
        self.levels, self.zeros = [], []
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append(BitRanks(bits))
            self.zeros.append(int((~bits).sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.bottom = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            ones = level.ones(at)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, at) - self.bottom[symbol]


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([x[n:], np.zeros(min(n, len(x)), x.dtype)])


class FmIndex:
    """Index of a text of symbols 1 .. sigma - 1 (0 ends each sequence), ordered by the first ``k`` symbols.

    Suffixes are ordered by their first ``k`` symbols only, which is all that patterns of ``k`` need: an interval of
    suffixes that begin with the same k - 1 symbols maps by backward search onto the interval of the pattern
    with one more symbol in front.
    """

    def __init__(self, text: np.ndarray, sigma: int, k: int):
        self.n, self.k = len(text), k
        ranks, size = {1: text.astype(np.int64)}, 1
        while 2 * size <= k - 1:
            ranks[2 * size] = _rank_pairs(ranks[size], _ahead(ranks[size], size))
            size *= 2
        order, done = ranks[size], size
        for step in sorted(ranks, reverse=True):
            while done + step <= k - 1:
                order = _rank_pairs(order, _ahead(ranks[step], done))
                done += step
        full = _rank_pairs(order, _ahead(ranks[1], done))
        self.suffixes = np.argsort(full, kind="stable")
        self.bwt = WaveletMatrix(text[self.suffixes - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        shorter = order[self.suffixes]
        starts = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
        group = np.cumsum(np.concatenate([[0], (shorter[1:] != shorter[:-1]).astype(np.int64)]))
        self.parent_start = starts[group]  # of the interval with the same first k - 1 symbols
        self.parent_end = np.append(starts[1:], self.n)[group]
        ranked = full[self.suffixes]
        self.full_starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with ``symbol`` put in front."""
        base = self.smaller[symbol]
        return base + self.bwt.rank(symbol, lo), base + self.bwt.rank(symbol, hi)

    def matches(self, queries: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Matching statistics of many queries at once, from their ends backward.

        Query i is ``queries[first[i] : first[i] + length[i]]``. For each place from which ``k`` symbols of the query are
        found in the index: the start of their interval, else -1; query after query, ``length - k + 1`` places each.
        The longest match kept is ``k``: beyond it the last symbol is dropped by stepping to the parent interval.
        """
        found = np.full(int(np.maximum(length - self.k + 1, 0).sum()), -1, np.int64)
        at = np.cumsum(np.maximum(length - self.k + 1, 0)) - np.maximum(length - self.k + 1, 0)
        live = np.flatnonzero(length >= self.k)
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        depth = np.zeros(len(length), np.int64)
        next_ = length - 1  # place of the symbol to put in front
        while len(live):
            place = next_[live]
            symbol = queries[first[live] + place]
            deep = depth[live] == self.k
            row = np.minimum(lo[live], self.n - 1)
            a = np.where(deep, self.parent_start[row], lo[live])
            b = np.where(deep, self.parent_end[row], hi[live])
            a, b = self.extend(symbol, a, b)
            hit = a < b
            # no match: the match must end one symbol earlier, and is searched anew from there
            next_[live] = np.where(hit | (depth[live] == 0), place - 1, place + depth[live] - 1)
            lo[live], hi[live] = np.where(hit, a, 0), np.where(hit, b, self.n)
            depth[live] = np.where(hit, np.minimum(depth[live] + 1, self.k), 0)
            whole = hit & (depth[live] == self.k)
            found[(at[live] + place)[whole]] = a[whole]
            live = live[next_[live] >= 0]
        return found
