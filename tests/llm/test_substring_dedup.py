import random

import numpy as np

from tests.llm import brute
from weftline.llm import substring_dedup as module
from weftline.llm.substring_dedup import factors, substring_dedup


def run(spark, rows, schema="doc_id long, text string", **kw):
    return substring_dedup(spark.createDataFrame(rows, schema), **kw).collect()


def same(spark, rows, window, gram):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, rows, window=window, gram=gram))
    assert got == sorted(brute.substring_dedup(rows, window))


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    got = substring_dedup(d, texts=False).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_dedup(rows))
    assert sum(r.n_removed for r in got) > 0


def test_random_overlaps(spark):
    rng = random.Random(5)
    for window, gram in ((6, 3), (5, 5), (4, 1)):
        base = [rng.choice("abcd") for _ in range(60)]
        rows = []
        for i in range(40):
            w = []
            for _ in range(rng.randint(0, 4)):
                a = rng.randint(0, 50)
                w += base[a : a + rng.randint(1, 25)] + [str(rng.randint(0, 3))]
            rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
        same(spark, rows, window, gram)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    other = "x " * 10 + passage + " y" * 10
    rows = [(3, None), (4, ""), (5, " \n "), (1, passage), (2, passage), (2, other), (7, "short text")]
    got = {(r.doc_id, r.n_words): r for r in run(spark, rows)}
    assert [got[k].n_removed for k in ((3, 0), (4, 0), (5, 0), (1, 60), (2, 60), (2, 80), (7, 2))] == [0, 0, 0, 0, 60, 60, 0]
    assert got[(2, 80)].kept_text == " ".join(["x"] * 10 + ["y"] * 10)
    assert [tuple(s) for s in got[(2, 80)].spans] == [(10, 70)]
    # a window twice in one document is no copy; null ids are kept and no reference
    assert [r.n_removed for r in run(spark, [(1, passage + " " + passage)])] == [0]
    assert [r.n_removed for r in run(spark, [(None, passage), (None, passage), (9, passage)])] == [0, 0, 0]
    assert run(spark, []) == []
    extra = run(spark, [(1, passage, 0, "k"), (8, passage, 1, "k")], "doc_id long, text string, row_key int, anchor string")
    assert sorted(r.n_removed for r in extra) == [0, 60]
    long = " ".join(str(i) for i in range(400_000))
    assert sorted(r.n_removed for r in run(spark, [(1, long), (2, long)], texts=False)) == [0, 400_000]


def rebuilt(rows, got):
    """Each text from its literals and, through its factors, from other documents' words."""
    split = {i: brute.words(t) for i, t in rows}
    for r in got:
        w, out, pos = split[r.doc_id], [], 0
        for f in r.factors:
            assert f.start >= pos and f.length > 0 and f.reference < r.doc_id
            out += w[pos : f.start] + split[f.reference][f.reference_start : f.reference_start + f.length]
            pos = f.start + f.length
        assert out + w[pos:] == w
        assert sum(f.length for f in r.factors) == r.n_removed == sum(s.end - s.start for s in r.spans)


def test_factors_rebuild_the_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = run(spark, rows)
    rebuilt(rows, got)
    assert sum(len(r.factors) for r in got) > 20
    rng = random.Random(9)
    base = [rng.choice("abcde") for _ in range(80)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randint(0, 70)
            w += base[a : a + rng.randint(1, 30)] + [str(rng.randint(0, 2))]
        rows.append((i, " ".join(w)))
    rebuilt(rows, run(spark, rows, window=6, gram=3))


def test_the_longest_match_is_the_next_factor():
    # row 0: reference 1 holds words 0 to 10, reference 2 words 4 to 14, reference 3 words 5 to 30 in two matches; then a gap
    row, at, n, ref, ref_at = (np.array(x) for x in zip((0, 0, 6, 1, 100), (0, 4, 6, 2, 0), (0, 5, 11, 3, 7), (0, 16, 10, 3, 18), (0, 40, 1, 4, 0), (2, 1, 1, 5, 1), strict=True))
    got = factors(row, at, n, ref, ref_at, 5)
    assert got.tolist() == [[0, 0, 10, 1, 100], [0, 10, 30, 3, 12], [0, 40, 45, 4, 0], [2, 1, 6, 5, 1]]
    assert factors(*(np.zeros(0, np.int64),) * 5, 5).shape == (0, 5)


def test_anchors_do_not_depend_on_the_position():
    """The same passage at the end of a text of 17 million words (more than 2^24) and alone has the same blocks."""
    words = module.Words
    passage = " ".join(f"w{i}" for i in range(300)).encode()
    long = np.frombuffer(b"a " * ((1 << 24) + 1000) + passage, np.uint8)
    alone = np.frombuffer(passage, np.uint8)
    keys = []
    for data in (long, alone):
        _, first, n, anchor, one, two = module.blocks(words(data, np.array([0, len(data)])), 50, 8)
        keys.append(set(zip(anchor.tolist(), n.tolist(), one.tolist(), two.tolist(), strict=True)))
    # all but the first block, which the words before it lengthen
    assert len(keys[1]) > 8 and len(keys[1] - keys[0]) <= 1
