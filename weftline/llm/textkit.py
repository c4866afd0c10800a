"""Array-at-a-time text primitives shared by the text operators.

Everything works on the UTF-8 bytes of an Arrow string column, a bounded piece of
a record batch at a time, so memory follows the piece and not the partition.
Words are maximal runs of bytes other than space and 0x09-0x0D; those bytes are
ASCII, so splitting bytes equals splitting characters.

Hashes are polynomial in Z/2^64, read from prefix sums (any substring in O(1)),
then finalised by the splitmix64 mixer. Equality of long word sequences is always
decided on two independent hashes (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
PIECE_ROWS = 2048

_M64 = (1 << 64) - 1
# Odd multipliers of the polynomial hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _accumulate(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base & _M64))
    p[0] = 1
    return np.multiply.accumulate(p)


@lru_cache(maxsize=6)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    return _accumulate(base, n), _accumulate(pow(base, -1, 1 << 64), n)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << max(10, int(n).bit_length())
    p, q = _powers(base, room) if room <= 1 << 22 else (_accumulate(base, n), _accumulate(pow(base, -1, 1 << 64), n))
    return p[:n], q[:n]


class Prefix:
    """Prefix sums of a sequence of 64-bit values; hashes of its slices."""

    def __init__(self, values: np.ndarray, base: int):
        p, self.inverse = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=1)
def _separators() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most PIECE_ROWS rows of about `most` bytes; a longer row comes alone."""
    data, off = string_bytes(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = min(a + PIECE_ROWS, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """The words of a run of texts.

    start, end: bytes of each word; first: n + 1 indices of the texts' first words;
    doc: the text of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data, self.off = (_lower()[data] if lower else data), off
        inside = ~_separators()[data]
        edge = off[(off > 0) & (off < len(data))]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return Prefix(byte_values()[self.data], BYTE_BASE).hash(self.start, self.end)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of k words in one text, and each run's text."""
        room = np.maximum(self.count - k + 1, 0)
        doc = np.repeat(np.arange(len(room)), room)
        skip = np.cumsum(room) - room
        return np.arange(len(doc)) - skip[doc] + self.first[:-1][doc], doc

    def joined(self, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
        """The kept words of all texts, each followed by one space, and n + 1 offsets of the texts in them."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        size = end - start + 1
        at = np.cumsum(size) - size
        total = int(size.sum())
        take = np.ones(total, np.int64)
        if total:
            take[0] = start[0]
            take[at[1:]] = start[1:] - end[:-1]
            np.cumsum(take, out=take)
            take[at + size - 1] = 0
        out = self.data[take] if total else np.zeros(0, np.uint8)
        if total:
            out[at + size - 1] = 0x20
        doc = self.doc if keep is None else self.doc[keep]
        n = np.bincount(doc, minlength=len(self.count)) if len(doc) else np.zeros(len(self.count), np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        return out.tobytes(), np.concatenate([at, [total]])[first]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, hashed: (hashes sorted in each text, text of each, n + 1 offsets).

    A text of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    h = words.hashes()
    p = Prefix(h, WORD_BASES[0])
    start, doc = words.runs(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    value = np.concatenate([p.hash(start, start + k), p.hash(words.first[short], words.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
        value, doc = value[new], doc[new]
    return value, doc, np.searchsorted(doc, np.arange(len(words.count) + 1))
