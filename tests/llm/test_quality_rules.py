import random

import numpy as np

from tests.llm import brute
from weftline.llm.quality_rules import BASE_RULES, RULES, Features, Rule, filter_quality, judge, order_rules, quality_report, sample_texts


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in quality_report(d).collect()}
    rows = d.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        q, want = got[r.doc_id], brute.quality(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (q.base_failed and q.kept)
    kept = filter_quality(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_verdict_does_not_depend_on_order(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id for r in filter_quality(d, rules=RULES).select("doc_id").collect()}
    b = {r.doc_id for r in filter_quality(d, rules=RULES[::-1], sample_rows=1).select("doc_id").collect()}
    assert a == b


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(40))
    texts = [None, "", " \n", good, good, "a\nb\na\n\na", "é|# <b>", good + "\n" + good]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    got = quality_report(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(map(brute.quality, texts))
    assert sorted(r.kept for r in got) == [False] * 6 + [True] * 2
    kept = filter_quality(spark.createDataFrame(rows, "doc_id long, text string, n_words string"))
    assert sorted(map(tuple, kept.collect())) == [(3, good, "x"), (4, good, "x")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality_report(none).collect() == [] and filter_quality(none).collect() == []


def test_rules_are_ranked_by_rejections_per_cost():
    order = order_rules(["a b"] * 50 + [None])
    by_name = {x["rule"]: x["rejected"] for x in order}
    assert by_name["enough_words"] == 1.0 and by_name["few_symbols"] == 0.0
    assert order[-1]["rejected"] == 0.0 and [x["rank"] for x in order] == sorted((x["rank"] for x in order), reverse=True)


def hostile():
    rng = random.Random(3)
    few, many = [f"w{i}" for i in range(6)], [f"{rng.choice('abcdefgh')}{i}x" for i in range(900)]
    out = []
    for _ in range(400):
        n, kind = rng.choice([19, 20, 49, 50, 60, 199, 200, 400]), rng.randrange(6)
        w = [rng.choice(many) for _ in range(n)]
        for _ in range(rng.choice([0, 2, 3, 5, 9])):
            at = rng.randrange(max(1, n - 4))
            w[at : at + 4] = [["in", "the", "end", "of"], ["1", "2", "3", "4"]][kind == 1]
        if kind == 2:
            w = [rng.choice(few + many[:9]) for _ in range(n)]
        if kind == 3:
            w = [x for y in w for x in ([y, "|"] if rng.random() < 0.2 else [y])]
        if kind == 4:
            w = [str(rng.randint(0, 99999)) if rng.random() < 0.3 else x for x in w]
        out.append(rng.choice([" ", "\n"]).join(w))
    return out


def test_verdict_against_brute_force(spark, sf_dir):
    texts = [*hostile(), None, "", "é" * 30, " ".join(["ab"] * 40), ("one two three. " * 9 + "\n") * 300, "x" * 200_000 + " y" * 50]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.kept for r in quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute.quality_kept(t) for i, t in rows}
    assert got == want and 50 < sum(want.values()) < len(rows) - 50
    kept = filter_quality(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()
    assert {r.doc_id for r in kept} == {i for i, k in want.items() if k}


def test_costly_rules_see_survivors_only():
    seen = []

    def costly(f):
        seen.append(len(f))
        return f["n_top4"] >= 0

    texts = ["too short"] * 90 + [" ".join(f"word{i}" for i in range(30))] * 10
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    f = Features(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert judge(f, (*BASE_RULES, Rule("costly", costly))).sum() == 10
    assert seen == [10] and "n_top4" not in f.memo


def test_order_is_by_what_the_rules_before_leave():
    half = Rule("half", lambda f: f["n_words"] != 1)
    same = Rule("same_half", lambda f: f["n_words"] != 1)
    order = {x["rule"]: x for x in order_rules(["a"] * 50 + ["a b"] * 50, (half, same))}
    assert sorted(x["rejected"] for x in order.values()) == [0.0, 0.5]  # alone, either rejects a half
    assert [x["rejected"] for x in order_rules(["a"] * 4 + ["a b"], (same,), (half,))] == [0.0]


def test_sample_is_spread(spark):
    d = spark.range(10_000, numPartitions=40).selectExpr("cast(id as string) text")
    got = sorted(int(t) for t in sample_texts(d))
    assert len(got) == 512 and got[0] < 250 and got[-1] > 9000
    assert sample_texts(d.limit(0)) == []
