import random
import re
from collections import Counter

import numpy as np

from weftline.llm.decontaminate import RADIUS, MultiIndex, coordinates, find_leaks, item_blocks, remove_leaks, simhash


def fold(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, k=5, percent=80):
    """Every item-sized window of every text against every item."""
    out = {}
    for d, t in docs:
        w = fold(t)
        for i, x in items:
            v = fold(x)
            if not v or i is None:
                continue
            width = min(k, len(v))
            sh = lambda z: [tuple(z[j : j + width]) for j in range(len(z) - width + 1)]
            item, best = Counter(sh(v)), None
            for a in range(len(w) - len(v) + 1):
                win = Counter(sh(w[a : a + len(v)]))
                both, n = sum((item & win).values()), sum(item.values())
                if 100 * both >= percent * (2 * n - both) and (best is None or both > best[0]):
                    best = (both, a, len(v), both / (2 * n - both))
            if best:
                out[d, i] = best[1:]
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.similarity) for r in df.collect()}


def test_table(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    words = {i: set(zip(*(fold(x)[j:] for j in range(5)), strict=False)) for i, x in items}
    near = []
    for d, t in rows:  # a window that shares no shingle can't be similar
        w = fold(t)
        s = set(zip(*(w[j:] for j in range(5)), strict=False))
        near.append((d, t, [(i, x) for i, x in items if words[i] & s]))
    want = {}
    for d, t, some in near:
        want |= plain([(d, t)], some)
    assert found(find_leaks(docs, bench)) == want and want
    assert found(find_leaks(docs, bench, most_words=300)) == want
    clean = remove_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_edited_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 30)}" for _ in range(rng.choice([1, 3, 5, 6, 20, 40, 60])))) for i in range(25)]
    docs = []
    for d in range(120):
        w = items[rng.randrange(25)][1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        pad = [f"p{rng.randint(0, 5)}" for _ in range(rng.randint(0, 30))]
        docs.append((d, ", ".join([*pad, *w, *pad]).upper() if d % 2 else " ".join([*pad, *w, *w])))
    got = found(find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain(docs, items)


def whole(docs, items, k=5, percent=80):
    """`plain`, and every text with fewer shingles than an item as one window."""
    out = plain(docs, items, k, percent)
    for d, t in docs:
        w = fold(t)
        for i, x in items:
            v = fold(x)
            width = min(k, len(v))
            if v and i is not None and width <= len(w) < len(v):
                a, b = (Counter(tuple(z[j : j + width]) for j in range(len(z) - width + 1)) for z in (w, v))
                both, either = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= percent * either:
                    out[d, i] = (0, len(w), both / either)
    return out


def test_texts_shorter_than_the_item(spark):
    rng = random.Random(7)
    items = [(i, " ".join(f"{rng.choice('abcdef')}{rng.randint(0, 4)}" for _ in range(rng.choice([2, 5, 6, 9, 20, 40, 60])))) for i in range(40)]
    items += [(50 + i, items[i][1] + " and more") for i in range(20)] + [(80, "na " * 30), (81, "na " * 40)]
    docs = [(0, " ".join(items[30][1].split()[:-3])), (1, "na " * 28), (2, "na " * 33), (3, items[0][1].split()[0])]
    for d in range(4, 300):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(1, 4)):
            if len(w) > 1:
                w.pop(rng.choice([0, -1, -2, rng.randrange(len(w))]))
        docs.append((d, " ".join(["pad"] * (d % 3) + w)))
    schemas = "doc_id long, text string", "item_id long, text string"
    want = whole(docs, items)
    assert len(want) > len(plain(docs, items)) + 50
    assert found(find_leaks(spark.createDataFrame(docs, schemas[0]), spark.createDataFrame(items, schemas[1]))) == want
    item = " ".join(f"w{j}" for j in range(40))  # 36 shingles
    docs = [(1, " ".join(item.split()[:-3])), (2, " ".join(item.split()[:1] + item.split()[2:])), (3, " ".join(item.split()[:32]))]
    docs += [(4, " ".join(item.split()[:33])), (5, " ".join(f"w{j}" for j in range(8, 40)))]
    bench = spark.createDataFrame([(9, item)], schemas[1])
    df = spark.createDataFrame(docs, schemas[0])
    assert found(find_leaks(df, bench)) == {(1, 9): (0, 37, 33 / 36), (2, 9): (0, 39, 34 / 37), (4, 9): (0, 33, 29 / 36)}
    assert sorted(r.doc_id for r in remove_leaks(df, bench).collect()) == [3, 5]


def test_multi_index_finds_everything_in_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    queries = np.concatenate([prints[:50] ^ np.uint64(0b1011 << 17), rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    for radius in (0, 5, 24):
        q, i = MultiIndex(prints, radius).search(queries)
        want = np.argwhere(np.bitwise_count(queries[:, None] ^ prints[None, :]) <= radius)
        assert sorted(zip(q, i, strict=True)) == sorted(map(tuple, want))


def test_edges(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = [(1, None, "a"), (2, "", "a"), (3, text, "a"), (3, text, "a"), (None, "x " + text.upper() + "!", "a"), (4, "zz", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, text), (8, None), (9, ""), (None, text)], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.first_word) for r in find_leaks(df, bench).collect()) == [("3", 7, 0), ("3", 7, 0), ("None", 7, 1)]
    assert sorted(r.doc_id for r in remove_leaks(df, bench).collect()) == [1, 2, 4]
    empty = bench.limit(0)
    assert find_leaks(df, empty).collect() == [] and remove_leaks(df, empty).count() == 6
    assert find_leaks(df.limit(0), bench).collect() == []
    assert [len(b) for b in item_blocks(spark.createDataFrame([(i, "a b c") for i in range(5)], "item_id long, text string"), most_words=6)] == [2, 2, 1]


def test_items_with_a_null_id_are_removed(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, "x " + text), (2, "zz"), (3, text + " and an other text of its own words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, "zz yy"), (7, "an other text of its own words"), (None, None)], "item_id long, text string")
    assert [r.doc_id for r in remove_leaks(docs, bench).collect()] == [2]
    both = spark.createDataFrame([(None, text), (7, text)], "item_id long, text string")
    assert sorted(r.doc_id for r in remove_leaks(docs, both).collect()) == [2]


def test_candidates_are_few_and_recall_is_high():
    """2,000 items of one size: candidates against all pairs, and windows at random similarities from 0.8 to 1 against brute force."""
    rng = np.random.default_rng(11)
    n, rows = 40, 2000
    items = rng.integers(0, 1 << 63, (rows, n)).astype(np.uint64)
    prints = np.concatenate([next(simhash(v, n)) for v in items])
    index = MultiIndex(prints)
    queries, want, lowest = [], [], []
    for i in range(rows):
        window, edits = items[i].copy(), int(rng.integers(0, n // 9 + 1))  # 2 * n * 80 / 180 shingles are shared at least
        window[rng.choice(n, edits, replace=False)] = rng.integers(0, 1 << 63, edits).astype(np.uint64)
        queries.append(next(simhash(window, n)))
        want.append(i)
        lowest.append(edits == n // 9)
    queries = np.concatenate(queries)
    near, lowest = 0, np.array(lowest)
    found = np.zeros(rows, bool)
    for a in range(0, rows, 100):
        q, item = index.candidates(queries[a : a + 100])
        near += len(q)
        q, item = index.search(queries[a : a + 100])
        assert (np.bitwise_count(queries[a : a + 100][q] ^ prints[item]).min(axis=1) <= RADIUS).all()
        found[a + q[item == a + q]] = True
    assert near <= 0.05 * rows * rows
    assert found.mean() >= 0.999 and found[lowest].mean() >= 0.99


def test_fingerprints_move_with_the_window():
    rng = np.random.default_rng(3)
    value = rng.integers(0, 50, 5000).astype(np.uint64)
    for n in (1, 7, 1500):
        got = np.concatenate(list(simhash(value, n)))
        assert len(got) == len(value) - n + 1
        for s in (0, 1, 1023, 1024, 1025, 2048, len(got) - 1):
            sums = coordinates(value[s : s + n]).sum(axis=0, dtype=np.int64)
            assert (np.packbits(sums > 0, bitorder="little").view("<u8") == got[s]).all()


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, f"{long} {item} {long}"), (3, "na " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, "na " * 30)], "item_id long, text string")
    assert found(find_leaks(docs, bench)) == {(2, 5): (400_000, 40, 1.0), (3, 6): (0, 30, 1.0)}
    assert [r.doc_id for r in remove_leaks(docs, bench, most_words=10).collect()] == [1]
