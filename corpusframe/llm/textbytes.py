"""Whole-batch text kernels over Arrow string buffers.

Every Python operator of this subpackage reads its words through these functions.  They work on the UTF-8 bytes of a
whole Arrow batch at once, so no Python object is made for a word.  A batch is first cut into pieces of bounded size
(`pieces`), hence memory does not grow with the batch; one text is never cut.  A very long text is hashed in steps of
`STEP` bytes or words, so besides its bytes only the bounds and the hashes of its words (24 bytes a word) are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000
PIECE_ROWS = 4096
#: Bytes (or words) that a kernel works on at once; a longer text is taken in several steps, so that intermediate arrays stay small.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1


def _class(negated: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    for lo, hi in negated:
        out[lo : hi + 1] = False
    return out


#: Words between ASCII white space, unchanged: [^\x20\x09-\x0D]+
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Letters, digits and everything beyond ASCII, after A-Z are lowered: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(seed: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """An odd base, its powers and those of its inverse modulo 2**64, and a random value for each byte."""
    base = (_BASE + 8 * seed) & _MASK
    with np.errstate(over="ignore"):
        p, q = (np.cumprod(np.full(STEP, x, dtype=np.uint64), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return base, p, q, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))


@dataclass
class Words:
    """The words of a piece: bytes (lowered if so asked), word bounds in them, and the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row, and the number of words at last
    row_byte: np.ndarray  # the first byte of each row, and the number of bytes at last

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every piece and task."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        base, p, q, values = _powers(seed)
        for a in range(0, len(self.data), STEP):
            b = min(a + STEP, len(self.data))
            i, j = int(np.searchsorted(self.end, a, side="right")), int(np.searchsorted(self.start, b, side="left"))
            if i == j:
                continue
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(values[self.data[a:b]] * p[: b - a], out=sums[1:])
            begin = self.start[i:j] - a
            part = sums[np.minimum(self.end[i:j] - a, b - a)] - sums[np.maximum(begin, 0)]
            part *= q[np.maximum(begin, 0)]
            if begin[0] < 0:  # a word from the step before
                part[0] *= np.uint64(pow(base, int(-begin[0]), 1 << 64))
            out[i:j] += part
        out += (self.end - self.start).astype(np.uint64)
        return mix(out)


def words(texts: pa.Array, letters: np.ndarray, lower: bool = False) -> Words:
    """The words of an Arrow string array; null has none."""
    data, off = raw(texts)
    if lower:
        data = LOWER[data]
    inside = letters[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(data))]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, start, end, np.searchsorted(start, off), off)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text and PIECE_ROWS rows at most; a longer text makes a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    _, off = raw(column)
    at = 0
    while at < len(column):
        to = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def row_hashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's words in order, from the words' hashes: a sum of random values of (place, word)."""
    counts = np.diff(first)
    out = counts.astype(np.uint64)
    for a in range(0, len(h), STEP):
        b = min(a + STEP, len(h))
        i, j = int(np.searchsorted(first[1:], a, side="right")), int(np.searchsorted(first[:-1], b, side="left"))
        begin, end = first[i:j], first[i + 1 : j + 1]
        place = np.arange(a, b) - np.repeat(begin, np.minimum(end, b) - np.maximum(begin, a))
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(mix(h[a:b] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
        out[i:j] += sums[np.minimum(end, b) - a] - sums[np.maximum(begin, a) - a]
    return mix(out)


def window_hashes(h: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `width` words inside one row: where it begins, and a hash of its words in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ok = np.ones(n, dtype=bool)
    for row_end in range(1, width):  # a window that holds a row's last word but not as its last crosses into the next row
        edge = first[1:] - row_end
        edge = edge[(edge >= 0) & (edge < n)]
        ok[edge] = False
    at = np.flatnonzero(ok)
    out = np.full(len(at), seed + 1, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
        out ^= out >> np.uint64(29)
    return at, mix(out)
