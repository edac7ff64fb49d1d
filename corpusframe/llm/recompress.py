"""Recompression: rounds that name runs of equal symbols, then pairs, so that equal substrings get equal symbols inside.

A round first replaces each run of one symbol by a symbol of its own, then each pair whose left symbol falls on one side
of a partition of the alphabet and whose right symbol falls on the other.  A name is a hash of what it stands for and the partition a
bit of the name, so all tasks give the same names.  How far to either side a symbol depends on other words is kept with it: a window of
words that reaches as far determines the symbol, wherever the window stands.

So equal windows determine the same symbols, and the largest ones that a window determines cover it without a gap or an overlap: words at
its edges, symbols of higher levels inside.  Their names and places are the window's name (`windows`).  A window depends on its own words
alone, so a very long text is parsed in overlapping parts of `PART` words with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusframe.llm.textbytes import mix

ROUNDS = 3
FAR = 1 << 20
PART = 1 << 18
_C = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Symbols:
    """Symbols of a level in order: name, first word, number of words, row, and how many words beside it on the left and right it depends on."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    left: np.ndarray
    right: np.ndarray


def _beside(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """How far the neighbours on the left and the right, and what they depend on, reach; FAR at a row's ends."""
    n = len(s.name)
    apart = s.row[1:] != s.row[:-1]
    left, right = np.full(n, FAR), np.full(n, FAR)
    left[1:] = np.where(apart, FAR, s.size[:-1] + s.left[:-1])
    right[:-1] = np.where(apart, FAR, s.size[1:] + s.right[1:])
    return left, right


def runs(s: Symbols, word: np.ndarray) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Each run of one symbol becomes one; also which symbol each old one has become a part of, and which symbols are new."""
    n = len(s.name)
    same = (s.name[1:] == s.name[:-1]) & (s.row[1:] == s.row[:-1])
    left, right = _beside(s)
    # a neighbour whose nearest word differs from the symbol's own word there is another symbol, whatever else it has
    end = s.start + s.size
    near = np.r_[False, (word[s.start[1:] - 1] != word[end[1:] - 1]) & (s.row[1:] == s.row[:-1])]
    left = np.where(near, 1, left)
    near = np.r_[(word[end[:-1]] != word[s.start[:-1]]) & (s.row[1:] == s.row[:-1]), False]
    right = np.where(near, 1, right)
    head = np.flatnonzero(np.r_[True, ~same])
    times = np.diff(np.r_[head, n])
    tail = head + times - 1
    name = np.where(times > 1, mix(s.name[head] * _C + times.astype(np.uint64)), s.name[head])
    return Symbols(name, s.start[head], s.size[head] * times, s.row[head], np.maximum(s.left[head], left[head]), np.maximum(s.right[tail], right[tail])), np.repeat(np.arange(len(head)), times), times > 1


def pairs(s: Symbols, turn: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Each pair of a left and a right symbol becomes one; also which symbol each old one has become a part of, and which symbols are new."""
    opens = (mix(s.name + np.uint64(turn)) & np.uint64(1)).astype(bool)
    joined = opens[:-1] & ~opens[1:] & (s.row[1:] == s.row[:-1])
    first, second = np.r_[joined, False], np.r_[False, joined]
    left, right = _beside(s)
    # alone: an opening symbol depends on what follows, another on what precedes it
    new_left = np.where(opens, s.left, np.maximum(s.left, left))
    new_right = np.where(opens, np.maximum(s.right, right), s.right)
    at = np.flatnonzero(first)
    name, size = s.name.copy(), s.size.copy()
    name[at] = mix((s.name[at] * _C) ^ (s.name[at + 1] + np.uint64(0x632BE59BD9B4E019)))
    size[at] += s.size[at + 1]
    new_left[at] = np.maximum(s.left[at], s.left[at + 1] - s.size[at])
    new_right[at] = np.maximum(s.right[at + 1], s.right[at] - s.size[at + 1])
    kept = np.flatnonzero(~second)
    return Symbols(name[kept], s.start[kept], size[kept], s.row[kept], new_left[kept], new_right[kept]), np.cumsum(~second) - 1, first[kept]


def symbols(word: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS):
    """All symbols of all levels, some at a time: name, first word, number of words, the first and last window that determines each, and the
    first and last one that determines the larger symbol of which it becomes a part."""
    n = len(word)
    none = np.zeros(n, dtype=np.int64)
    s = Symbols(word, np.arange(n), np.ones(n, dtype=np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first)), none, none)
    low, high = np.maximum(s.start + 1 - width, 0), s.start

    def step(old: Symbols, low: np.ndarray, high: np.ndarray, found: tuple[Symbols, np.ndarray, np.ndarray]):
        now, part, new = found
        head = np.searchsorted(part, np.arange(len(now.name)))
        now_low = np.where(new, np.maximum(now.start + now.size + now.right - width, 0), low[head])
        now_high = np.where(new, now.start - now.left, high[head])
        gone = np.flatnonzero(new[part])
        of = part[gone]
        return (old.name[gone], old.start[gone], old.size[gone], low[gone], high[gone], now_low[of], now_high[of]), now, now_low, now_high

    for turn in range(1, rounds + 1):
        if len(s.name) < 2:
            break
        told, s, low, high = step(s, low, high, runs(s, word))
        yield told
        told, s, low, high = step(s, low, high, pairs(s, turn))
        yield told
    yield s.name, s.start, s.size, low, high, np.full(len(low), FAR << 20), np.full(len(low), -1)


def _windows(word: np.ndarray, first: np.ndarray, width: int, rounds: int, named: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(word)
    best = [np.zeros(n + width, dtype=np.uint64) for _ in range(int(width).bit_length())]
    total = np.zeros(n if named else 0, dtype=np.uint64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * _C) | np.uint64(1)
    for name, start, size, low, high, upper_low, upper_high in symbols(word, first, width, rounds):
        ok = np.flatnonzero(low <= high)
        if len(ok) < len(low):
            name, start, size, low, high, upper_low, upper_high = (x[ok] for x in (name, start, size, low, high, upper_low, upper_high))
        key = (size.astype(np.uint64) << np.uint64(58)) | (name >> np.uint64(6))
        span = high - low + 1
        for k in range(len(best)):
            at = np.flatnonzero((span >> k) == 1)
            if len(at):
                np.maximum.at(best[k], low[at], key[at])
                np.maximum.at(best[k], high[at] - (1 << k) + 1, key[at])
        for d in range(width if named else 0):
            i = start - d
            at = np.flatnonzero((i >= low) & (i <= high) & ((i < upper_low) | (i > upper_high)))
            total[i[at]] += name[at] * factor[d]
    for k in range(len(best) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(best[k - 1], best[k], out=best[k - 1])
        np.maximum(best[k - 1][half:], best[k][:-half], out=best[k - 1][half:])
    return best[0][:n], mix(total)


def windows(word: np.ndarray, first: np.ndarray, width: int, rounds: int = ROUNDS, named: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For the window of `width` words that begins at each word, its anchor: the longest (then the largest name) of the symbols that it
    determines; and if `named` its name: a hash of the largest symbols that it determines and of their places.  Where no window begins the values mean
    nothing."""
    if len(word) <= 2 * PART:
        return _windows(word, first, width, rounds, named)
    anchor, name = np.zeros(len(word), dtype=np.uint64), np.zeros(len(word) if named else 0, dtype=np.uint64)
    for a in range(0, len(word), PART):
        b = min(a + PART + width, len(word))
        inside = np.r_[a, first[(first > a) & (first < b)], b] - a
        parts = _windows(word[a:b], inside, width, rounds, named)
        end = min(a + PART, len(word))
        anchor[a:end] = parts[0][: end - a]
        if named:
            name[a:end] = parts[1][: end - a]
    return anchor, name
