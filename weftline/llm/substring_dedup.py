"""Substring dedup: relative Lempel-Ziv parsing of each document against all earlier ones.

Words are unchanged `[^\\x20\\x09-\\x0D]+` runs. A window is `window` consecutive
words of one document; a word is removed when a window that covers it also starts
in a document with a smaller id. Windows are judged on the input.

How the parse is distributed. A suffix structure over the whole corpus can't be
built or broadcast, so reference blocks are cut by content: the smallest hashed
`gram` in each window is the window's anchor, and the windows that share an anchor
occurrence form one block of `window` to 2 * window - gram words. Equal text gives
equal blocks wherever it stands, so one shuffle by anchor indexes every block of
every document.

* Inside a factor, whole blocks match: an occurrence in a document other than the
  block's smallest one is a copy of that one, the reference.
* At factor boundaries a block differs from its references on one side. Only there,
  and only for the block's smallest occurrence (every other one is a whole match),
  single windows are compared, again by one shuffle of their hashes.
* The parse. Matches that copy from one reference at one distance and touch are one match.
  From left to right the match that reaches furthest becomes the next factor (start,
  length, reference document and word), up to its end; words under no match are literals.
  Every match is `window` words or longer, so the factors cover the duplicate spans, and
  the text is rebuilt from literals and references. Where only counts and digests are asked
  for (`texts` false), places in the reference are not carried: touching matches are one factor.

Blocks and windows are equal when two independent 64-bit hashes are. Repeated
passages meet as rows of one anchor and are never paired. The texts' shuffle is
used twice (one reused exchange); spans travel as integers.

Nulls, empty texts and texts under `window` words: nothing is removed. Rows with a
null id: kept whole, and they are no reference. Rows that share an id are one
document for the rule "smaller id", each with its own row in the result. Further
columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import bound_batches
from weftline.llm.textkit import WORD_BASES, Prefix, Words, pieces

BLOCK = "doc_id long, row_key long, first int, n_windows int, anchor long, block long, block2 long"
WINDOW = "doc_id long, row_key long, at int, w1 long, w2 long"


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of x[i : i + width] for each i, by doubling."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)

    out, have = np.arange(len(x)), 1
    while 2 * have <= width:
        out = lesser(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return lesser(out[: len(out) - rest], out[rest:]) if rest else out


def blocks(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each block: its text, first word (index in `words`), number of windows, anchor hash and two hashes of its words."""
    h = words.hashes()
    p, q = (Prefix(h, b) for b in WORD_BASES)
    at, doc = words.runs(window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    grams = np.arange(len(h) - gram + 1)
    value = p.hash(grams, grams + gram)
    least = _sliding_argmin(value, window - gram + 1)[at]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.concatenate([new, [len(at)]]))
    first, end = at[new], at[new] + n - 1 + window
    return doc[new], first, n, value[least[new]], p.hash(first, end), q.hash(first, end)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("row_key")
            for a, _, data, off in pieces(b.column("text")):
                w = Words(data, off)
                doc, first, n, anchor, one, two = blocks(w, window, gram)
                rows = pa.array(a + doc)
                cols = [ids.take(rows), keys.take(rows), pa.array((first - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), _signed(anchor), _signed(one), _signed(two)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "first", "n_windows", "anchor", "block", "block2"])

    return run


def _list(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, ...]:
    """(row, *fields) of a column of arrays of structs."""
    col = b.column(name)
    n = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(len(n)), n), *(np.asarray(flat.field(i), np.int64) for i in range(flat.type.num_fields))


def _windows(window: int):
    """Hashes of the windows at factor boundaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, n = _list(b, "open")
            ids, keys = b.column("doc_id"), b.column("row_key")
            for a, end, data, off in pieces(b.column("text")):
                mine = slice(*np.searchsorted(row, [a, end]))
                if mine.start == mine.stop:
                    continue
                w = Words(data, off)
                r, total = row[mine] - a, int(n[mine].sum())
                skip = np.cumsum(n[mine]) - n[mine]
                pick = np.repeat(np.arange(len(r)), n[mine])
                inner = at[mine][pick] + np.arange(total) - skip[pick]
                start = w.first[:-1][r[pick]] + inner
                h = w.hashes()
                rows = pa.array(a + r[pick])
                cols = [ids.take(rows), keys.take(rows), pa.array(inner.astype(np.int32)), *(_signed(Prefix(h, x).hash(start, start + window)) for x in WORD_BASES)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row_key", "at", "w1", "w2"])

    return run


def factors(row: np.ndarray, at: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> np.ndarray:
    """The greedy parse: rows of (row, start, end, reference, its first word), disjoint and in order.

    Matches are n windows from `at` on, equal to those of `ref` from `ref_at` on.
    """
    if not len(row):
        return np.zeros((0, 5), np.int64)
    far, end = ref_at - at, at + n - 1 + window
    order = np.lexsort((at, far, ref, row))
    row, at, end, ref, far = row[order], at[order], end[order], ref[order], far[order]
    # one reference at one distance: matches that touch are one
    side = np.concatenate([[True], (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (far[1:] != far[:-1])])
    room = int(end.max()) + 1
    reach = np.maximum.accumulate(end + np.cumsum(side) * room)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] + np.cumsum(side)[1:] * room > reach[:-1]) | side[1:]]))
    row, at, end, ref, far = row[new], at[new], np.maximum.reduceat(end, new), ref[new], far[new]
    order = np.lexsort((-end, at, row))
    out: list[tuple[int, int, int, int, int]] = []
    now = pos = best = -1  # the row, the word after its last factor, the match that reaches furthest from there
    reach = 0
    cols = [x[order].tolist() for x in (row, at, end, ref, far)]
    i, size = 0, len(order)
    while i < size or best >= 0:
        here = i < size and cols[0][i] == now
        if here and cols[1][i] <= pos:
            if cols[2][i] > reach:
                best, reach = i, cols[2][i]
            i += 1
        elif best >= 0 and reach > pos:
            out.append((now, pos, reach, cols[3][best], pos + cols[4][best]))
            pos, best = reach, -1
        else:
            best = -1
            if i < size:
                now, pos, reach = cols[0][i], cols[1][i], cols[1][i]
    return np.array(out, np.int64)


def _cut(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, n, *refs = _list(b, "matched")
            ref, ref_at = refs or (np.zeros(len(at), np.int64), at)
            row, start, end, ref, ref_start = factors(row, at, n, ref, ref_at, window).T
            for a, e, data, off in pieces(b.column("text")):
                w = Words(data, off)
                mine = slice(*np.searchsorted(row, [a, e]))
                r, s, t = row[mine] - a, start[mine], end[mine]
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, w.first[:-1][r] + s, 1)
                np.add.at(edge, w.first[:-1][r] + t, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept, at_byte = w.joined(keep)
                view = memoryview(kept)
                left = [view[x : max(x, y - 1)] for x, y in zip(at_byte[:-1], at_byte[1:], strict=True)]
                gone = w.count - (np.bincount(w.doc[keep], minlength=len(w.count)) if len(w) else 0)
                cols = {"doc_id": b.column("doc_id").slice(a, e - a), "n_words": pa.array(w.count.astype(np.int64)), "n_removed": pa.array(gone.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left])}
                if texts:
                    cols["kept_text"] = pa.array([str(x, "utf-8") for x in left])
                    # factors that touch are one span
                    new = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != t[:-1])]) if len(r) else np.zeros(0, bool)
                    last = np.concatenate([new[1:], [True]]) if len(r) else new
                    cols["spans"] = _lists(r[new], e - a, start=s[new].astype(np.int32), end=t[last].astype(np.int32))
                    cols["factors"] = _lists(r, e - a, start=s.astype(np.int32), length=(t - s).astype(np.int32), reference=ref[mine], reference_start=ref_start[mine].astype(np.int32))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def _lists(row: np.ndarray, n: int, **fields: np.ndarray) -> pa.Array:
    """For each of n rows, in order, an array of its structs."""
    cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))


FACTORS = "array<struct<start: int, length: int, reference: long, reference_start: int>>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, with `texts`, kept_text, the removed spans and the factors.

    `kept_sha256` is of the kept words joined by one space; `spans` are half-open
    ranges of words, factors without a gap between them are one span. A factor's
    `reference` is the document it copies from (of rows that share the id, one).
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be from 1 to window")
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows with one id stay apart: a key from the row itself; equal rows have equal results
    src = src.withColumn("row_key", F.xxhash64("doc_id", "text"))
    key = ["anchor", "block", "block2", "n_windows"]
    found = src.filter("doc_id is not null").mapInArrow(_blocks(window, gram), BLOCK)
    # never null; said here, so that each use below has these filters and equal uses share one exchange
    found = found.filter(" and ".join(f"{c} is not null" for c in key))
    # one row a block: a passage that a third of all texts share is pre-aggregated to a row a task
    place = (lambda at: F.struct("doc_id", at)) if texts else (lambda at: F.col("doc_id"))
    ref, ref_at = (F.col("ref.doc_id"), [F.col("ref").getField("first").alias("ref_at")]) if texts else (F.col("ref"), [])
    known = found.groupBy(*key).agg(F.min(place("first")).alias("ref"), F.max("doc_id").alias("last"))
    # anchors whose blocks begin in different documents: a smaller document may hold a block in part
    # (`last` is read here only so that both uses of `known` read the same columns and share one exchange)
    contested = known.groupBy("anchor").agg(F.min("ref").alias("lo"), F.max("ref").alias("hi"), F.max("last").alias("end"))
    lo, hi = ("lo.doc_id", "hi.doc_id") if texts else ("lo", "hi")
    contested = contested.filter(f"{lo} < {hi} and end >= {lo}").select("anchor", F.lit(True).alias("contested"))
    known = known.join(contested, "anchor", "left").filter((ref < F.col("last")) | F.col("contested"))
    known = known.select(*key, ref.alias("ref"), *ref_at, F.coalesce("contested", F.lit(False)).alias("contested"))
    more = ["ref", "ref_at"] if texts else []
    found = found.join(known, key).select("doc_id", "row_key", "first", "n_windows", *more, (F.col("doc_id") > F.col("ref")).alias("whole"), "contested")
    span = F.struct(F.col("first").alias("at"), F.col("n_windows").alias("n"))
    match = F.struct(F.col("first").alias("at"), F.col("n_windows").alias("n"), *more)
    spans = found.filter("whole or contested").groupBy("doc_id", "row_key").agg(F.collect_set(F.when(F.col("whole"), match)).alias("whole"), F.collect_set(F.when(~F.col("whole"), span)).alias("open"))
    # the text comes along only where windows are to be hashed; both joins of texts use one exchange
    opened = src.join(spans.select("doc_id", "row_key", "open"), ["doc_id", "row_key"], "left")
    opened = opened.select("doc_id", "row_key", F.when(F.size("open") > 0, F.col("text")).alias("text"), "open")
    windows = opened.mapInArrow(_windows(window), WINDOW)
    first = windows.groupBy("w1", "w2").agg(F.min(place("at")).alias("ref"), F.max("doc_id").alias("last")).filter(ref < F.col("last"))
    first = first.select("w1", "w2", ref.alias("ref"), *([F.col("ref.at").alias("ref_at")] if texts else []))
    late = windows.join(first, ["w1", "w2"]).filter("doc_id > ref").select("doc_id", "row_key", F.struct("at", F.lit(1).alias("n"), *more).alias("span"))
    matched = spans.select("doc_id", "row_key", F.explode("whole").alias("span")).unionByName(late)
    matched = matched.groupBy("doc_id", "row_key").agg(F.collect_set("span").alias("matched"))
    # a left join by value keeps rows whose id is null
    out = src.join(matched, ["doc_id", "row_key"], "left").select("doc_id", "text", "matched")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + f", kept_text string, spans array<struct<start: int, end: int>>, factors {FACTORS}" * texts
    return out.mapInArrow(_cut(window, texts), schema)


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50)
), late AS (
  SELECT r, i FROM windows JOIN (SELECT k, min(doc_id) AS least FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k) WHERE doc_id > least
), gone AS (SELECT DISTINCT r, i + x AS place FROM late, range(50) AS o(x)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""
