"""An FM-index over a sequence of symbols: suffix order, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a prefix, for many symbols and prefixes at once: one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.n = len(symbols)
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `prefix` symbols."""
        start, at = np.zeros_like(prefix), prefix
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[start], ones[at]
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The suffixes in order, by prefix doubling.  Zeros are separators: each is a symbol of its own, in order of position."""
    n = len(sequence)
    stops = sequence == 0
    key = np.where(stops, np.cumsum(stops) - 1, sequence + np.count_nonzero(stops)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    step = 1
    while True:
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])] if n else np.zeros(0, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        follow = np.zeros(n, dtype=np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        step *= 2


class FmIndex:
    """`sequence` holds symbols from 1 on and ends with a separator 0; separators may stand anywhere and match nothing."""

    def __init__(self, sequence: np.ndarray, alphabet: int, every: int = 16):
        n = len(sequence)
        order = suffix_order(sequence)
        self.bwt = sequence[order - 1].astype(np.int64)
        self.less = np.zeros(alphabet + 2, dtype=np.int64)
        np.cumsum(np.bincount(sequence, minlength=alphabet + 1)[: alphabet + 1], out=self.less[1:])
        self.tree = WaveletMatrix(self.bwt, alphabet + 1)
        first = np.ones(n, dtype=bool)
        first[1:] = sequence[:-1] == 0
        sampled = first | (np.arange(n) % every == 0)
        self.is_sampled = sampled[order]
        self.sample = np.where(self.is_sampled, order, -1)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (one a row, of one length): the range of suffixes that begin with each."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.bwt), dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.less[c] + self.tree.rank(c, low[alive])
            high[alive] = self.less[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        dead = np.ones(len(phrases), dtype=bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrase and the position of each occurrence: steps back through the text until a sampled suffix."""
        sizes = high - low
        phrase = np.repeat(np.arange(len(low)), sizes)
        row = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        position = np.zeros(len(row), dtype=np.int64)
        walked, open_ = 0, np.arange(len(row))
        while len(open_):
            here = row[open_]
            done = self.is_sampled[here]
            position[open_[done]] = self.sample[here[done]] + walked
            open_, here = open_[~done], here[~done]
            c = self.bwt[here]
            row[open_] = self.less[c] + self.tree.rank(c, here)
            walked += 1
        return phrase, position
