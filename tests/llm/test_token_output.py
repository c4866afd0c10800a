import zlib

import numpy as np
import pytest

from weftline.llm import rans
from weftline.llm.queries import tokenizer_path
from weftline.llm.token_output import read_ids, read_index, write_tokens


def plain(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]


def check(spark, rows, path, schema="doc_id long, text string", data=None):
    write_tokens(spark.createDataFrame(data or rows, schema), path, tokenizer_path())
    want, start = [], 0
    for i, ids in plain(rows):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_index(spark, path).collect()), key=lambda r: r[1]) == want
    assert sorted((r.doc_id, r.ids) for r in read_ids(spark, path).collect() if r.doc_id is not None) == sorted((i, x) for i, x in plain(rows) if i is not None)


def test_table(spark, sf_dir, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check(spark, rows, str(tmp_path / "t"))


def test_edges(spark, tmp_path):
    rows = [(None, "first"), (-3, "A  B c\n​É é <|endoftext|>x it's 12"), (0, None), (1, ""), (2, "tie a"), (2, "tie b"), (9, "x\x1cy " * 3000)]
    check(spark, rows, str(tmp_path / "t"), "doc_id long, text string, part string, seq int", [(*r, "p", 0) for r in rows[::-1]])
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), tokenizer_path())
    assert read_index(spark, str(tmp_path / "none")).collect() == []


def test_small_shards_keep_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("weftline.llm.token_output.SHARD_TOKENS", 300)
    check(spark, [(i, f"word number {i} " * (i % 40)) for i in range(200)], str(tmp_path / "t"))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 600_000])
def test_rans_round_trip(n):
    tokens = np.minimum(np.random.default_rng(n).zipf(1.2, n), 49_000).astype(np.uint32)
    table, blocks = rans.encode_shard(tokens)
    assert (rans.decode_shard(table, blocks) == tokens).all()


def test_rans_checkpoints_and_checksum():
    tokens = np.random.default_rng(1).integers(0, 300, rans.BLOCK_TOKENS).astype(np.uint32)
    table, blocks = rans.encode_shard(tokens)
    t = rans.Table.unpack(table)
    args = (t.symbols, t.slots.astype(np.uint64), t.starts(), np.repeat(np.arange(len(t.slots)), t.slots))
    size = rans.CHECK_STEPS * rans.LANES
    for k in range(len(blocks[0]["marks"])):
        assert (rans.decode_block(blocks[0], *args, mark=k, stretch=True) == tokens[k * size : (k + 1) * size]).all()
    broken = blocks[0] | {"stream": blocks[0]["stream"][:-4] + b"\0\0\0\1"}
    with pytest.raises(rans.Corrupt):
        rans.decode_block(broken, *args)
