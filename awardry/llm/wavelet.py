"""Suffix arrays with the ranks of dyadic blocks, and a wavelet matrix with range successors, for use inside tasks."""

from __future__ import annotations

import numpy as np


class Blocks:
    """A sequence's suffix array, and for each k the rank of the block of 2**k symbols at each place.

    A rank is the first place in the suffix array of the suffixes that begin with that block; sizes[k] tells at a rank how
    many there are. Each doubling sorts only suffixes that aren't told apart yet. The last level has different
    ranks alone. A block that reaches beyond the end equals no other.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.suffixes = np.argsort(symbols, kind="stable")
        self.ranks: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        slots, first, second = np.arange(n), symbols[self.suffixes], np.zeros(n, np.int64)
        rank, step = np.zeros(n, np.int64), 1
        while True:
            new = np.ones(len(slots), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(slots)))
            rank = rank.copy()
            rank[self.suffixes[slots]] = np.repeat(slots[starts], counts)
            size = np.ones(n, np.int64)
            size[slots[starts]] = counts
            self.ranks.append(rank)
            self.sizes.append(size)
            slots = slots[np.repeat(counts > 1, counts)]
            if not len(slots):
                return
            at = self.suffixes[slots]
            first, second = rank[at], np.full(len(at), -1)
            inside = at + step < n
            second[inside] = rank[at[inside] + step]
            order = np.argsort(first * (n + 1) + second + 1)
            self.suffixes[slots], first, second = at[order], first[order], second[order]
            step *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i on equal those from places j on, for i < j."""
        i, j, n = i.copy(), j.copy(), len(self.suffixes)
        begun = j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = np.flatnonzero(j + (1 << k) <= n)
            same = inside[self.ranks[k][i[inside]] == self.ranks[k][j[inside]]]
            i[same] += 1 << k
            j[same] += 1 << k
        return j - begun

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before places i equal those before places j, for i < j."""
        i, j = i.copy(), j.copy()
        begun = j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = np.flatnonzero(i >= 1 << k)
            same = inside[self.ranks[k][i[inside] - (1 << k)] == self.ranks[k][j[inside] - (1 << k)]]
            i[same] -= 1 << k
            j[same] -= 1 << k
        return begun - j


class WaveletMatrix:
    """Numbers of 0 or more in a fixed order; counts and order statistics of any range of places, for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            ones = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values at places from left up to right are less than x."""
        over = x >> self.bits > 0
        found = np.where(over, right - left, 0)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l, r = zeros[left], zeros[right]
            one = (x >> b & 1).astype(bool)
            found += np.where(one & ~over, r - l, 0)
            left, right = np.where(one, zeros[-1] + left - l, l), np.where(one, zeros[-1] + right - r, r)
        return found

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) at places from left up to right, which must hold more than k."""
        found = np.zeros(len(left), np.int64)
        for b, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            l, r = zeros[left], zeros[right]
            one = k >= r - l
            found |= one.astype(np.int64) << b
            k = np.where(one, k - (r - l), k)
            left, right = np.where(one, zeros[-1] + left - l, l), np.where(one, zeros[-1] + right - r, r)
        return found
