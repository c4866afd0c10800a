"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts and items are folded alike: A-Z lower-cased, every other ASCII character that
isn't a digit or letter is a gap. Shingles are `k` words (an item with fewer words is
one shingle of its own width). A window has as many shingles as the item; a text with
fewer is one window of its own size.

* Where: two windows of n shingles are similar only if they share 2 * n * percent /
  (100 + percent), so windows are formed where that many shingles of items of the size
  lie within n places, and nowhere else.
* Fingerprint: SimHash of TABLES words of 64 bits. Each shingle has a coordinate for each
  bit (an odd number from its hash, so sums hardly tie) and counts as often as it occurs;
  a bit is the sign of the window's sum.
* Search: each word is cut into 4 blocks of 16 bits, and blocks are probed with up to
  RADIUS // 4 = 2 flipped bits. That finds every item of the size that lies within RADIUS
  bits in any word, from 2,740 probes whatever the number of items.
  Of unlike pairs 4 % become candidates. At similarity 0.8, the least, a bit differs with
  probability 0.15 and a word lies outside the radius with 0.26, all five with 0.001;
  at 0.9 with 1e-7. Measured on random edits over the whole range of 0.8 to 1: see README.
* Texts with fewer shingles than an item are one window, searched among the fingerprints of
  that item's size, where enough of their shingles are known.
* Verification: sum of minimal counts / sum of maximal counts of the shingles, at
  least `percent` / 100, in integers.

One pass over the documents, no shuffle. Items are taken in blocks of at most
ITEM_WORDS words (one longer item makes a block), so what a task and the driver hold is
bounded; a larger benchmark means more passes, each written before the next.

Null or empty texts and items match nothing. Null document ids are reported as null. An
item with a null id can't be reported, so `find_leaks` leaves it out; `remove_leaks`
removes its passages as any other's. Rows are judged alone; of equally similar windows the first counts. `find_leaks` drops further
columns, `remove_leaks` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch, bound_batches, lean
from weftline.llm.textkit import WORD_BASES, Prefix, Words, mix, pieces, string_bytes

TABLES, RADIUS = 5, 11
ITEM_WORDS = 1 << 20
STARTS, QUERIES = 1024, 128


def _folds() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    t[48:58], t[97:123], t[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
    t[65:91] = np.arange(97, 123)
    return t


FOLD = _folds()


def coordinates(values: np.ndarray) -> np.ndarray:
    """TABLES * 64 coordinates of each shingle, odd numbers from -255 to 255 that its hash alone decides."""
    lanes = np.arange(1, TABLES * 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return 2 * mix(values[:, None] + lanes).view(np.uint8).astype(np.int16) - 255


def simhash(values: np.ndarray, n: int, count: int | None = None) -> Iterator[np.ndarray]:
    """Fingerprints of values[s : s + n] for s < count (all windows), STARTS of them at a time: rows of TABLES 64-bit words.

    A shingle weighs as often as it occurs. The sums move along with the window, so
    memory doesn't grow with n or count.
    """
    count = len(values) - n + 1 if count is None else count
    now = np.zeros(TABLES * 64, np.int64)
    for a in range(0, n, STARTS):
        now += coordinates(values[a : min(n, a + STARTS)]).sum(axis=0, dtype=np.int64)
    for a in range(0, count, STARTS):
        m = min(STARTS, count - a)
        sums = np.empty((m, TABLES * 64), np.int64)
        sums[0] = now
        end = min(a + m, count - 1)  # the last window has nothing after it
        moves = coordinates(values[a + n : end + n]).astype(np.int64) - coordinates(values[a:end])
        np.cumsum(moves[: m - 1], axis=0, out=sums[1:])
        sums[1:] += now
        if len(moves) == m:
            now = sums[-1] + moves[-1]
        yield np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def _flips(most: int) -> np.ndarray:
    """All 16-bit masks of at most `most` bits."""
    x = np.arange(1 << 16)
    return x[np.bitwise_count(x) <= most].astype(np.uint64)


class MultiIndex:
    """Fingerprints (rows of one or more words) of the items of all groups by their 16-bit blocks.

    Of two words at most `radius` bits apart one of the four blocks differs in at most
    radius // 4 bits, so probing every block with up to that many flipped bits finds all
    of them. A probe looks at a bitmap first; the number of probes does not depend on the
    number of items.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, group: np.ndarray | int = 0):
        self.prints, self.radius = prints.reshape(len(prints), -1), radius
        prints = self.prints
        keys = np.concatenate([self._keys(prints, group, t, b) for t in range(prints.shape[1]) for b in range(4)] or [np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], np.tile(np.arange(len(prints)), prints.shape[1] * 4)[order]
        self.mask = np.uint64((1 << max(16, 5 + len(keys).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)
        self.maybe[(keys & self.mask).astype(np.int64)] = True
        self.flips = _flips(radius // 4)

    @staticmethod
    def _keys(prints: np.ndarray, group: np.ndarray | int, table: int, block: int, flips: np.ndarray | None = None) -> np.ndarray:
        part = (prints[:, table] >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        place = np.asarray(group, np.uint64) * np.uint64(prints.shape[1] * 4) + np.uint64(table * 4 + block)
        if flips is not None:
            part = part[:, None] ^ flips
        return mix((place << np.uint64(16)) | part)

    def candidates(self, queries: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, item), each once, of the items of a group that share a block up to radius // 4 bits."""
        queries = queries.reshape(len(queries), -1)
        found = [np.zeros(0, np.int64)]
        for t in range(queries.shape[1]):
            for b in range(4):
                keys = self._keys(queries, group, t, b, self.flips).ravel()
                at = np.flatnonzero(self.maybe[(keys & self.mask).astype(np.int64)])
                lo, hi = (np.searchsorted(self.keys, keys[at], side) for side in ("left", "right"))
                q = np.repeat(at // len(self.flips), hi - lo)
                place = np.arange(len(q)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
                found.append(q * len(self.prints) + self.items[place])
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints)))

    def search(self, queries: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All (query, item) of the group with a word at most `radius` bits apart."""
        q, item = self.candidates(queries, group)
        near = (np.bitwise_count(queries.reshape(len(queries), -1)[q] ^ self.prints[item]) <= self.radius).any(axis=1)
        return q[near], item[near]


@dataclass
class _Class:
    """Items of one shingle width and number of shingles: their place in the index, ids, counted and all shingles."""

    group: int
    items: list[int | None]
    first: int
    counted: list[tuple[np.ndarray, np.ndarray]]
    known: np.ndarray


def _common(counted: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> int:
    """Sum of the minimal counts of an item's and a window's shingles."""
    u, c = counted
    place = np.minimum(np.searchsorted(u, values), len(u) - 1)
    return int(np.minimum(np.bincount(place[u[place] == values], minlength=len(u)), c).sum())


class Benchmark:
    """A block of items: their shingles by width, and one index of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, str]], k: int):
        groups: dict[tuple[int, int], list] = {}
        self.keys: dict[int, np.ndarray] = {}
        data, off = string_bytes(pa.array([t for _, t in items], pa.string()))
        w = Words(FOLD[data], off)
        p = Prefix(w.hashes(), WORD_BASES[0])
        for i, (item, _) in enumerate(items):
            if n := int(w.count[i]):
                width = min(k, n)
                at = np.arange(w.first[i], w.first[i + 1] - width + 1)
                groups.setdefault((width, n - width + 1), []).append((item, p.hash(at, at + width)))
        for width in {c[0] for c in groups}:
            self.keys[width] = np.unique(np.concatenate([v for (x, _), group in groups.items() if x == width for _, v in group]))
        self.maybe = {}
        for width, keys in self.keys.items():
            size = 1 << max(16, 4 + int(len(keys)).bit_length())
            self.maybe[width] = np.zeros(size, bool)
            self.maybe[width][(keys & np.uint64(size - 1)).astype(np.int64)] = True
        self.classes: dict[tuple[int, int], _Class] = {}
        prints, of = [np.zeros((0, TABLES), np.uint64)], []
        for g, (c, group) in enumerate(groups.items()):
            self.classes[c] = _Class(g, [i for i, _ in group], len(of), [np.unique(v, return_counts=True) for _, v in group], np.unique(np.concatenate([v for _, v in group])))
            prints += [next(simhash(v, c[1])) for _, v in group]
            of += [g] * len(group)
        self.index = MultiIndex(np.concatenate(prints), RADIUS, np.array(of, np.uint64))

    def leaks(self, w: Words, percent: int) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity), the best window of each text and item."""
        best: dict[tuple[int, int], tuple] = {}
        p = Prefix(w.hashes(), WORD_BASES[0]) if len(w) else None
        for width, keys in self.keys.items():
            at, doc = w.runs(width)
            if not len(at):
                continue
            value = p.hash(at, at + width)
            maybe = self.maybe[width]
            hits = np.flatnonzero(maybe[(value & np.uint64(len(maybe) - 1)).astype(np.int64)])
            hits = hits[keys[np.minimum(np.searchsorted(keys, value[hits]), len(keys) - 1)] == value[hits]]
            if not len(hits):
                continue
            room = np.maximum(w.count - width + 1, 0)
            end = np.cumsum(room)
            for (x, n), c in self.classes.items():
                if x != width:
                    continue
                mine = hits[c.known[np.minimum(np.searchsorted(c.known, value[hits]), len(c.known) - 1)] == value[hits]]
                for s, t, m in self._runs(mine, doc, room, end, n, percent):
                    self._search(value, s, t, m, n, c, percent, lambda s, m: (int(doc[s]), int(at[s] - w.first[doc[s]]), m + width - 1), best)
        return [(d, i, first, size, -s) for (d, i), (s, first, size) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is not None, x[0][1] or 0))]

    @staticmethod
    def _runs(mine: np.ndarray, doc: np.ndarray, room: np.ndarray, end: np.ndarray, n: int, percent: int) -> Iterator[tuple[int, int, int]]:
        """(first start, last start, shingles) of windows with enough of the class's shingles to be similar to one of its items."""
        ds, shared = np.unique(doc[mine], return_counts=True)
        for d in ds[(room[ds] < n) & ((100 + percent) * shared >= percent * (n + room[ds]))]:
            s = int(end[d] - room[d])
            yield s, s, int(room[d])
        least = -(-2 * n * percent // (100 + percent))
        if len(mine) < least:
            return
        a, b = mine[: len(mine) - least + 1], mine[least - 1 :]
        lo, hi = np.maximum(b - n + 1, (end - room)[doc[a]]), np.minimum(a, end[doc[a]] - n)
        lo, hi = lo[hi >= lo], hi[hi >= lo]
        if len(lo):
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1] + 1]))
            yield from ((int(s), int(t), n) for s, t in zip(lo[new], np.maximum.reduceat(hi, new), strict=True))

    def _search(self, value, s: int, t: int, m: int, n: int, c: _Class, percent: int, told, best: dict) -> None:
        """The windows of m shingles that start at s to t against the items of a class, of n shingles."""
        near: dict[int, list[np.ndarray]] = {}
        for i, prints in enumerate(simhash(value[s : t + m], m)):
            for j in range(0, len(prints), QUERIES):
                q, item = self.index.search(prints[j : j + QUERIES], c.group)
                start = s + i * STARTS + j + q
                for x in np.unique(item):
                    near.setdefault(int(x), []).append(start[item == x])
        for x, starts in near.items():
            counted = c.counted[x - c.first]
            # beside a window within the radius the neighbours are verified too: their fingerprints may lie just outside
            reach = n * (100 - percent) // (100 + percent) + 1
            around = np.unique(np.concatenate([np.arange(max(s, a - reach), min(t, a + reach) + 1) for a in np.unique(np.concatenate(starts))]))
            for a in around.tolist():
                both = _common(counted, value[a : a + m])
                if 100 * both >= percent * (n + m - both):
                    d, first, words = told(a, m)
                    found = (-both / (n + m - both), first, words)
                    key = (d, c.items[x - c.first])
                    if key not in best or found < best[key]:
                        best[key] = found


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most_words: int = ITEM_WORDS, unnamed: bool = False) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most `most_words` words, streamed through the driver one block at a time; those with a null id if `unnamed`."""
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).filter((F.lit(unnamed) | F.col(item_col).isNotNull()) & F.col(text_col).isNotNull())
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        n = len(text.split())
        if block and held + n > most_words:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += n
    if block:
        yield block


LEAKS = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def _find(items: list[tuple[int | None, str]], k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items, k)
        for b in batches:
            for a, _, data, off in pieces(b.column("text")):
                if found := bench.leaks(Words(FOLD[data], off), percent):
                    d, i, first, size, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([a + x for x in d])), pa.array(i, pa.int64()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def _one_by_one(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the last one."""
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        yield block, after is None
        block = after


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", most_words: int = ITEM_WORDS) -> DataFrame:
    """One row per document and item whose text stands in it: the most similar window, in words of the folded text."""
    spark = docs.sparkSession
    bound_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out, scratch = spark.createDataFrame([], LEAKS), None
    for n, (items, last) in enumerate(_one_by_one(item_blocks(benchmark, most_words=most_words))):
        part = src.mapInArrow(_find(items, k, percent), LEAKS)
        if n == 0 and last:
            return part
        # of several blocks each pass is written, so that the driver lets go of its items
        scratch = scratch or Scratch(spark, "leaks")
        out = out.unionByName(scratch.write(part, str(n)))
    return out


def _clean(items: list[tuple[int | None, str]], k: int, percent: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items, k)
        for b in batches:
            for a, e, data, off in pieces(b.column(text_col)):
                keep = np.ones(e - a, bool)
                keep[[d for d, *_ in bench.leaks(Words(FOLD[data], off), percent)]] = False
                yield b.slice(a, e - a).filter(pa.array(keep))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text_col: str = "text", most_words: int = ITEM_WORDS) -> DataFrame:
    """The documents without a leak, all columns unchanged."""
    bound_batches(docs.sparkSession)
    scratch = None
    for n, (items, last) in enumerate(_one_by_one(item_blocks(benchmark, most_words=most_words, unnamed=True))):
        docs = docs.mapInArrow(lean(_clean(items, k, percent, text_col)), docs.schema)
        if not last:  # so that a worker and the driver hold one block of items
            scratch = scratch or Scratch(docs.sparkSession, "clean")
            docs = scratch.write(docs, str(n))
            if n:
                scratch.drop(str(n - 1))
    return docs
