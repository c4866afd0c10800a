"""Token ids of whole texts in binary shards, in ascending id order, and their reader.

Format: a Parquet folder, one row a shard of about SHARD_TOKENS tokens (whole
documents): `part` and `seq` give the order of the shards, `doc_id` and `doc_tokens`
the documents in order, `table` the packed frequency table and `blocks` the
independent coded blocks (see rans.py). Parquet is the container for its commit
protocol and because any store that Spark reaches can hold it.

Writing: one range shuffle by id, then each task tokenizes, counts and codes its
stretch shard by shard; memory holds one shard. Words are tokenized once and kept in
a bounded cache: the tokenizer never joins characters across white space, so a
text's ids are its words' ids in order.

Null and empty texts have only the end id. Null ids come first. Rows that share an
id stand next to each other, ordered by text. Further columns are dropped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import rans
from weftline.llm.shared import bound_batches, give_back, lean
from weftline.llm.textkit import BYTE_BASE, WORD_BASES, Prefix, Words, byte_values, pieces

SHARD_TOKENS = 1 << 21
CACHE_BITS = 20
PIECE_BYTES = 1 << 19
SLOT_IDS = 12
TOGETHER = 200
PIECE_ROWS = 256

BLOCKS = "array<struct<n: int, lanes: int, stream: binary, marks: array<struct<at: long, states: binary>>, crc: long>>"
SHARDS = f"part int, seq int, n_tokens long, first_doc long, doc_id array<long>, doc_tokens array<long>, table binary, blocks {BLOCKS}"
_MARK = pa.struct([("at", pa.int64()), ("states", pa.binary())])
_BLOCK = pa.struct([("n", pa.int32()), ("lanes", pa.int32()), ("stream", pa.binary()), ("marks", pa.list_(_MARK)), ("crc", pa.int64())])
_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("table", pa.binary()), ("blocks", pa.list_(_BLOCK))])


class WordTokenizer:
    """Ids of texts by a `tokenizers` file; a word is encoded once while it is in the cache.

    The cache is direct-mapped: a word's 128-bit hash (two polynomials over its bytes)
    names one of 2^CACHE_BITS slots of up to SLOT_IDS ids, and a later word takes it over.
    All words of a piece are looked up at once as arrays. Missing words are encoded many
    at a time, with the word `0` between them: a digit is a token of its own in such
    files, so its id cuts the others' ids apart. Words that hold it, and all words of
    files without that property, are encoded singly. The cache lives as long as the worker.
    """

    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        zero = self._ids(["0", "ab 0 b 0", "ab", "b"])
        self.zero = zero[0][0] if len(zero[0]) == 1 and zero[1] == [*zero[2], zero[0][0], *zero[3], zero[0][0]] and zero[0][0] not in zero[2] + zero[3] else None
        slots = 1 << CACHE_BITS
        self.key1, self.key2 = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.count = np.zeros(slots, np.uint8)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.ids = np.zeros(slots * SLOT_IDS, np.uint16 if small else np.uint32)

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n + 1 offsets) of words."""
        plain = [self.zero is not None and b"0" not in w for w in words]
        together = [w for w, p in zip(words, plain, strict=True) if p]
        alone = [np.asarray(x, np.uint32) for x in self._ids([w.decode() for w, p in zip(words, plain, strict=True) if not p])]
        parts, ends = [], []
        for a in range(0, len(together), TOGETHER):
            part = together[a : a + TOGETHER]
            ids = np.asarray(self._ids([(b" 0 ".join(part) + b" 0").decode()])[0], np.uint32)
            cut = np.flatnonzero(ids == self.zero)
            if len(cut) != len(part):
                raise ValueError("the tokenizer joins words")
            ends.append(np.diff(cut, prepend=-1) - 1)
            parts.append(np.delete(ids, cut))
        n = np.zeros(len(words), np.int64)
        n[np.array(plain, bool)] = np.concatenate([np.zeros(0, np.int64), *ends])
        n[~np.array(plain, bool)] = [len(x) for x in alone]
        off = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(off[-1]), np.uint32)
        mine = np.repeat(np.array(plain, bool), n)
        out[mine] = np.concatenate([np.zeros(0, np.uint32), *parts])
        out[~mine] = np.concatenate([np.zeros(0, np.uint32), *alone])
        return out, off

    def _piece(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        w = Words(data, off)
        values = byte_values()[data]
        one, two = (Prefix(values, b).hash(w.start, w.end) for b in (BYTE_BASE, WORD_BASES[0]))
        slot = (one & np.uint64((1 << CACHE_BITS) - 1)).astype(np.int64)
        hit = (self.key1[slot] == one) & (self.key2[slot] == two) & (self.count[slot] > 0)
        n = self.count[slot].astype(np.int64)
        base = slot * SLOT_IDS
        miss = np.flatnonzero(~hit)
        fresh = np.zeros(0, np.uint32)
        if len(miss):
            order = miss[np.lexsort((two[miss], one[miss]))]
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            first = order[new]
            raw = data.tobytes()
            fresh, at = self._learn([raw[s:e] for s, e in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
            kind = np.cumsum(new) - 1
            size = np.diff(at)
            n[order], base[order] = size[kind], at[:-1][kind]
        size = np.concatenate([[0], np.cumsum(n)])
        inner = np.arange(size[-1]) - np.repeat(size[:-1] - base, n)
        old = np.repeat(hit, n)
        out = np.empty(int(size[-1]), np.uint32)
        out[old] = self.ids[inner[old]]
        out[~old] = fresh[inner[~old]]
        if len(miss):
            fit = np.flatnonzero((n[first] > 0) & (n[first] <= SLOT_IDS))
            # of new words with one slot the last stays, whole
            _, last = np.unique(slot[first[fit]][::-1], return_index=True)
            fit = fit[::-1][last]
            to, k = slot[first[fit]], n[first[fit]]
            self.key1[to], self.key2[to], self.count[to] = one[first[fit]], two[first[fit]], k
            skip = np.repeat(np.cumsum(k) - k, k)
            step = np.arange(int(k.sum())) - skip
            self.ids[np.repeat(to * SLOT_IDS, k) + step] = fresh[np.repeat(at[:-1][fit], k) + step]
        doc = size[w.first]
        return [out[a:b] for a, b in zip(doc[:-1].tolist(), doc[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [x for _, _, data, off in pieces(texts, PIECE_BYTES) for x in self._piece(data, off)]


def _encode(tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = WordTokenizer.of(tokenizer_path), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], "<u4")

        def shard() -> pa.RecordBatch:
            table, blocks = rans.encode_shard(np.concatenate(tokens))
            row = {"part": part, "seq": seq, "n_tokens": held, "first_doc": ids[0], "doc_id": ids, "doc_tokens": [len(x) for x in tokens], "table": table, "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], _SHARD)

        for b in batches:
            for a in range(0, b.num_rows, PIECE_ROWS):
                piece = b.slice(a, PIECE_ROWS)
                for doc, x in zip(piece.column(0).to_pylist(), tokenizer.encode(piece.column(1)), strict=True):
                    ids.append(doc)
                    tokens.append(np.concatenate([x, end]))
                    held += len(x) + 1
                    if held >= SHARD_TOKENS:
                        yield shard()
                        ids, tokens, held, seq = [], [], 0, seq + 1
                        give_back()
        if ids:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all texts, each followed by `end_id`, to a new folder."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    src.mapInArrow(lean(_encode(tokenizer_path, end_id)), SHARDS).write.mode("error").option("compression", "none").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in b.schema.names}
            tokens = rans.decode_shard(row["table"], row["blocks"])
            end = np.cumsum(row["doc_tokens"])
            start = end - row["doc_tokens"]
            n = len(end)
            cols = [pa.array([row[k]] * n, pa.int32()) for k in ("part", "seq")]
            cols += [pa.array(row["doc_id"], pa.int64()), pa.array(start), pa.array(row["doc_tokens"], pa.int64()), pa.array([rans.crc(tokens[s:e]) for s, e in zip(start, end, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            tokens = rans.decode_shard(b.column("table")[i].as_py(), b.column("blocks")[i].as_py())
            sizes = b.column("doc_tokens")[i].as_py()
            cut = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(b.column("doc_id")[i].as_py(), pa.int64()), pa.ListArray.from_arrays(cut, pa.array(tokens.astype(np.int64)))], ["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the ids of each document, decoded and checked, block by block."""
    return spark.read.schema(SHARDS).parquet(path).select("doc_id", "doc_tokens", "table", "blocks").mapInArrow(_ids, "doc_id long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files.

    The starts come from two prefix sums: over the parts (as many as the write had
    tasks), then over the shards of each part.
    """
    files = spark.read.schema(SHARDS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.withColumn("base", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards = files.select("part", "seq", "n_tokens").join(parts.select("part", "base"), "part")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("part", "seq", (F.col("base") + before).alias("base"))
    docs = files.select("part", "seq", "doc_id", "doc_tokens", "table", "blocks").mapInArrow(lean(_decode), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(shards, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
