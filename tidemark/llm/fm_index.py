"""A word-level FM-index: suffix array, wavelet tree over the Burrows-Wheeler transform, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of an integer text in order, by prefix doubling; only ties are sorted again.

    A suffix that ends counts as smaller than one that goes on.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    starts = np.searchsorted(text[order], text[order], side="left")
    rank = np.empty(n, np.int64)
    rank[order] = starts  # the place of the group's first suffix
    width = 1
    tied = _tied(rank[order])
    while len(tied):
        at = order[tied]
        ahead = at + width
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[at]
        within = np.lexsort((key, group))
        at, key, group = at[within], key[within], group[within]
        order[tied] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        rank[at] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        tied = tied[_tied_mask(rank[at])]
        width *= 2
    return order


def _tied_mask(rank: np.ndarray) -> np.ndarray:
    same = np.zeros(len(rank), bool)
    if len(rank) > 1:
        equal = rank[1:] == rank[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    return same


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_tied_mask(rank))


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector a level, most significant bit first, zeros before ones."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = sequence
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, level in enumerate(reversed(range(self.levels))):
            ones, bit = self.ones[k], (symbol >> level) & 1
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit == 1, self.zeros[k] + lo1, lo - lo1)
            hi = np.where(bit == 1, self.zeros[k] + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros_like(at)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Search in a text of symbols 1 and up; 0 stands between stretches, which no phrase crosses."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletTree(text[order - 1], symbols)
        kept = (order % sample == 0) | (text[order - 1] == 0)  # a stretch's first word too: no walk crosses a 0
        self.marked = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (a row, filled up behind its length), all at once from the back."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in range(int(lengths.max(initial=0))):
            alive = alive[lo[alive] < hi[alive]]
            some = alive[lengths[alive] > k]
            if not len(some):
                break
            symbol = phrases[some, lengths[some] - 1 - k]
            lo[some], hi[some] = self.step(symbol, lo[some]), self.step(symbol, hi[some])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back until a sampled one."""
        found, walked = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        at, left = rows.astype(np.int64), np.arange(len(rows))
        while len(left):
            here = self.marked[at + 1] > self.marked[at]
            done = left[here]
            found[done] = self.positions[self.marked[at[here]]] + walked[done]
            left, at = left[~here], at[~here]
            walked[left] += 1
            at = self.step(self.tree.access(at), at)
        return found
