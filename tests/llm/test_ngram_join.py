import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from weftline.llm.ngram_join import index_entries, jaccard_components, need


def got(spark, rows, schema="doc_id long, text string", **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, schema), **kw).collect()}


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute.components([tuple(r) for r in d.collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(d).collect()} == want
    assert sum(i != c for i, (_, c) in want.items()) > 5


def test_random_sets_near_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for g in range(30):
        base = [f"{g % 3}w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 4, 5, 6, 8, 9, 12, 15, 20, 33, 64, 130]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            a = rng.randint(0, max(1, len(w) // 9))
            rows.append((len(rows) * 7 - 50, " ".join(w[a:] + base[: rng.randint(0, max(1, len(w) // 9))])))
    rng.shuffle(rows)
    for percent in (80, 60):
        assert got(spark, rows, percent=percent) == brute.components(rows, percent=percent)
    assert got(spark, rows, k=1) == brute.components(rows, k=1)


def test_every_linked_pair_meets():
    """The pigeonhole itself: pairs at the threshold share an entry, at every small size."""
    rng = np.random.default_rng(8)
    for n in [*range(1, 40), 63, 64, 100, 127, 128, 260, 500]:
        for percent in (80, 67, 90):
            x = rng.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(5)
            for m in {n, 100 * n // percent, (n + 100 * n // percent) // 2}:
                both = -(-percent * (n + m) // (100 + percent))
                if both > min(n, m):
                    continue
                y = np.concatenate([x[:both], rng.integers(0, 1 << 62, m - both).astype(np.uint64) * np.uint64(5) + np.uint64(1)])
                value = np.concatenate([np.sort(x), np.sort(y)])
                doc = np.repeat([0, 1], [n, m])
                entry, owner = index_entries(value, doc, np.array([n, m]), percent)
                assert set(entry[owner == 0]) & set(entry[owner == 1]), (n, m, percent)
                if n > 60:
                    assert len(entry) < 2.6 * (need(np.array([n, m]), percent)).sum()


def _one_entry(sets):
    """All sets in one index entry, so that only the leader is compared at first and the differences must do the rest."""

    def outer(k, percent):
        inner = sets(k, percent)

        def run(batches):
            for b in inner(batches):
                n = b.num_rows
                same = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.ones(n, np.int64)))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], same], b.schema.names)

        return run

    return outer


@pytest.mark.parametrize("percent", [80, 60])
def test_differences_to_one_leader_find_every_link(spark, monkeypatch, percent):
    from weftline.llm import ngram_join

    monkeypatch.setattr(ngram_join, "_sets", _one_entry(ngram_join._sets))
    rng = random.Random(percent)
    passage, rows = [f"p{i}" for i in range(30)], []
    for family in range(14):
        own = [f"f{family}x{i}" for i in range(rng.choice([0, 3, 12, 25, 60, 120]))]
        base = passage[: rng.choice([30, 30, 10])] + own if family % 3 else own or passage
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
            rows.append((len(rows), " ".join(w[rng.randint(0, 2) :] + passage[: rng.choice([0, 0, 2])])))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(ids[i], t) for i, t in rows]
    assert got(spark, rows, percent=percent) == brute.components(rows, percent=percent)


def test_edges(spark):
    t = "one two three four five six seven"
    rows = [(5, t), (3, t.upper()), (9, None), (8, ""), (7, " "), (6, "a b"), (2, "A  b"), (4, "b a"), (None, t)]
    want = {5: (3, 3), 3: (3, 3), 9: (0, 9), 8: (0, 8), 7: (0, 7), 6: (1, 2), 2: (1, 2), 4: (1, 4), None: (3, None)}
    assert got(spark, rows) == want
    assert got(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, entry int, node int") == want
    assert got(spark, []) == {}
    # É is not lower-cased; rows with one id are one node
    assert got(spark, [(1, "É b c d e"), (2, "é b c d e")]) == {1: (1, 1), 2: (1, 2)}
    two = jaccard_components(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (2, "x y z"), (3, "x y z")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, two)) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_group_of_near_copies_in_a_chain(spark):
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(w)
        w[(i * 3) % 200] = f"new{i}"
        rows.append((100 - i, " ".join(w)))
    assert got(spark, rows) == brute.components(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_many_edits_of_one_text(spark, seed):
    """Most copies are not linked with the leader, some of those with each other; edits come from a small pool."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    pool = [(rng.randrange(150), f"e{i}") for i in range(14)]
    rows = []
    for i in range(160):
        w = list(base)
        for at, new in rng.sample(pool, rng.randint(0, 9)):
            w[at] = new
        rows.append((i * 3 % 160, " ".join(w[rng.randint(0, 6) : 150 - rng.randint(0, 6)])))
    rows += [(900 + i, " ".join(base[i : i + 128 - i])) for i in range(0, 30, 3)]
    for percent in (80, 70):
        want = brute.components(rows, percent=percent)
        assert got(spark, rows, percent=percent) == want
        assert percent != 80 or len({c for _, c in want.values()}) > 3


def test_hot_entries_are_counted_like_others(spark, monkeypatch):
    """A group of near copies and one of exact copies that make most rows; only the result's table stays."""
    import os

    from weftline.llm import ngram_join

    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(150)] + [(150 + i, " ".join(base[:199] + [f"z{i}"])) for i in range(150)]
    rows += [(300 + i, " ".join(rng.choice(base) for _ in range(40))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 1)
    monkeypatch.setattr(ngram_join, "SAMPLE", 3)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = ngram_join.jaccard_components(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert [os.listdir(f"{shared}/{d}") for d in set(os.listdir(shared)) - before] == [["result"]]


def test_long_text(spark):
    long = " ".join(f"w{i % 5003}x{i % 41}" for i in range(150_000))
    rows = [(2, long), (1, long + " end"), (3, " ".join(reversed(long.split()))), (4, "short text")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 4}
