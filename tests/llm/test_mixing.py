from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm.mixing import mix_documents, mix_sources

SCHEMA = "doc_id long, text string, source string"


def targets(sizes, weights, budget, most):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check(df, weights=(3, 1, 2), budget=1.5, most=2.0):
    out = mix_sources(df, weights, budget, most).collect()
    sizes = defaultdict(int)
    for r in out:
        assert r.mix_size == len(brute.words(r.text))
        sizes[r.source] += r.mix_size
    want = targets(sizes, weights, budget, most) if sizes else {}
    taken = defaultdict(int)
    for r in out:
        assert r.mix_source_size == sizes[r.source]
        assert abs(r.mix_target - want[r.source]) < 1e-6
        assert 0 <= r.mix_taken <= -(-most // 1) * r.mix_size
        taken[r.source] += r.mix_taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mix_sources(df.repartition(7), weights, budget, most).collect()), key=repr)
    return out


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(d)
    check(d, (1,), 0.3, 1.0)
    check(d, (5, 1), 1.9, 2.0)


def test_mixed_documents_have_the_words_taken(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r.doc_id: r.mix_taken for r in mix_sources(d).collect()}
    mixed = mix_documents(d)
    assert mixed.columns == d.columns
    words, whole = defaultdict(int), {r.doc_id: r.text for r in d.collect()}
    cut = 0
    for r in mixed.collect():
        words[r.doc_id] += len(brute.words(r.text))
        assert whole[r.doc_id].startswith(r.text)
        cut += whole[r.doc_id] != r.text
    assert words == {i: n for i, n in plan.items() if n}
    assert cut <= d.select("source").distinct().count()


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (4, "one two three", None), (None, "p q", "b"), (5, " ", "c"), (6, "é è", "É")]
    check(spark.createDataFrame(rows, SCHEMA))
    check(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA))
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 7).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"), F.lit(0).alias("ranges"))
    check(hot)
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
