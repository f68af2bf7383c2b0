"""An FM-index over words: wavelet-tree ranks for backward search, sampled suffix positions to locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class FmIndex:
    """Index of a text of symbols 1.. with separators 0; a separator matches nothing.

    Suffixes are sorted by prefix doubling with every separator distinct. The Burrows-Wheeler transform is held
    as a wavelet tree in level order: one bit vector with prefix counts per bit of the symbol.
    """

    def __init__(self, text: np.ndarray):
        text = np.append(text.astype(np.int64), 0)
        self.n = n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text + (len(ends) - 1)
        rank[ends] = np.arange(len(ends))
        depth = 1
        while True:
            other = np.zeros(n, np.int64)
            other[:max(n - depth, 0)] = rank[depth:] + 1
            key = rank * (int(rank.max()) + 2 + n) + other
            rows = np.argsort(key, kind="stable")
            ranked = key[rows]
            fresh = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
            rank = np.empty(n, np.int64)
            rank[rows] = fresh
            if fresh[-1] == n - 1:
                break
            depth *= 2
        self.separators = len(ends)
        transform = text[rows - 1]
        self.top = int(text.max()) + 1
        counts = np.bincount(text, minlength=self.top + 1)
        self.first = np.cumsum(counts) - counts
        self.bits = max(1, self.top.bit_length())
        self.ones, self.zeros = [], []
        level = transform
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.marked = rows % SAMPLE == 0
        self.samples = rows[self.marked]
        self.sample_rank = np.cumsum(self.marked) - 1
        # Rows before a separator's text begin: a walk can't pass them, so they are samples too.
        self.stops = transform == 0
        self.stop_at = rows[self.stops]
        self.stop_rank = np.cumsum(self.stops) - 1

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` symbols of the transform."""
        begin, end = np.zeros(len(at), np.int64), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbol >> b & 1).astype(bool)
            ones = self.ones[k]
            begin = np.where(one, self.zeros[k] + ones[begin], begin - ones[begin])
            end = np.where(one, self.zeros[k] + ones[end], end - ones[end])
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            symbol = symbol << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return symbol

    def search(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of right-aligned phrases, all extended leftwards side by side; an empty interval where one does not occur."""
        low, high = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        for t in range(phrases.shape[1]):
            live = np.flatnonzero((lens > t) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - t]
            known = (symbol > 0) & (symbol < self.top)
            symbol = np.where(known, symbol, 0)
            s, e = self.rank(symbol, low[live]), self.rank(symbol, high[live])
            low[live], high[live] = np.where(known, self.first[symbol] + s, 0), np.where(known, self.first[symbol] + e, 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk left until a sampled suffix."""
        out, at, open_, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            mark, stop = self.marked[at], self.stops[at]
            out[open_[mark]] = self.samples[self.sample_rank[at[mark]]] + steps
            only = stop & ~mark
            out[open_[only]] = self.stop_at[self.stop_rank[at[only]]] + steps
            go = ~(mark | stop)
            at, open_ = at[go], open_[go]
            symbol = self.access(at)
            at = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return out
