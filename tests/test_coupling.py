"""Hand-computed coupling cases."""

import random
import threading

import pytest

from weftline.operators import coupling as cp

CASES = {
    "isolated": ([], {"A": (0, 0, 0, 0)}),
    "direct": (["AB"], {"A": (0, 1, 0, 1), "B": (1, 0, 1, 0)}),
    "forward_chain": (["AB", "BC", "CD"], {"A": (0, 1, 0, 3), "B": (1, 1, 1, 2)}),
    "backward_chain": (["AB", "BC", "CD"], {"D": (1, 0, 3, 0), "C": (1, 1, 2, 1)}),
    "diamond": (["AB", "AC", "BD", "CD"], {"A": (0, 2, 0, 3), "D": (2, 0, 3, 0)}),
    "cycle": (["AB", "BC", "CA"], {"A": (1, 1, 2, 2), "B": (1, 1, 2, 2)}),
    "complex": (["AB", "AC", "BD", "CD", "CE"], {"A": (0, 2, 0, 4), "D": (2, 0, 3, 0)}),
    "balanced": (["AB", "BC"], {"B": (1, 1, 1, 1)}),
    "loop": (["AA", "AB"], {"A": (1, 2, 0, 1), "B": (1, 0, 1, 0)}),
}


def frames(spark, edges, kind="uses"):
    nodes = sorted(set("A" + "".join(edges)))
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame([(e[0], e[1], kind) for e in edges], "source_id string, target_id string, edge_type string")


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("method", ["frontier", "doubling"])
def test_cases(spark, name, method):
    edges, want = CASES[name]
    n, e = frames(spark, edges)
    direct = {r.id: (r.ca, r.ce) for r in cp.degrees(n, e).collect()}
    far = {r.id: (r.tca, r.tce) for r in cp.transitive_coupling(n, e, method=method).collect()}
    assert {k: direct[k] + far[k] for k in want} == want


def test_instability_and_parallel_edges(spark):
    n, e = frames(spark, ["AB", "AC"])
    got = {r.id: r.instability for r in cp.direct_coupling(n, e.union(frames(spark, ["AB"], "extends")[1])).collect()}
    assert got == {"A": 1.0, "B": 0.0, "C": 0.0}
    assert {r.id: r.ce for r in cp.degrees(n, e.union(frames(spark, ["AB"], "extends")[1])).collect()}["A"] == 3
    assert {r.id: r.ce for r in cp.degrees(n, e.union(frames(spark, ["AB"], "imports")[1])).collect()}["A"] == 2


def test_random_graphs_and_sums(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 14), rng.randint(0, 14)) for _ in range(22)]
    n = spark.createDataFrame([(str(i),) for i in range(15)], "id string")
    e = spark.createDataFrame([(str(a), str(b), "uses") for a, b in pairs], "source_id string, target_id string, edge_type string")
    reach = {a: {b for x, b in pairs if x == a} for a in range(15)}
    for _ in range(15):
        reach = {a: s | {c for b in s for c in reach[b]} for a, s in reach.items()}
    want = sorted((str(a), str(b)) for a, s in reach.items() for b in s if a != b)
    assert sorted(map(tuple, cp.closure(e).collect())) == sorted(map(tuple, cp.closure(e, "doubling").collect())) == want
    d = cp.coupling(n, e).collect()
    assert sum(r.ca for r in d) == sum(r.ce for r in d) == len(pairs)
    assert sum(r.tca for r in d) == sum(r.tce for r in d) == len(want)
    assert all(0 <= r.instability <= 1 for r in d)


def test_doubling_of_a_large_ring(spark):
    n = 2000  # 4 million pairs; joined with each other they are 8 billion rows
    e = spark.range(n).selectExpr("concat('n', id) source_id", f"concat('n', (id + 1) % {n}) target_id")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert cp.closure(e, "doubling").distinct().count() == n * (n - 1)
    finally:
        late.cancel()


@pytest.mark.parametrize("thin", [0, 4])
def test_doubling_by_edges_where_pairs_are_many(spark, monkeypatch, thin):
    for name, value in {"THIN": thin, "CHEAP": 0, "WORDS": 1, "BITMAP": 100}.items():  # several blocks and partitions of numbers
        monkeypatch.setattr(cp, name, value)
    rng = random.Random(thin)
    pairs = [(f"a{i}", f"a{rng.randrange(150)}") for i in range(150) for _ in range(2)] + [(f"b{i}", f"b{i + 1}") for i in range(20)] + [("b20", "a3"), ("b5", "b2"), ("a1", "a1"), (None, "a2"), ("a2", None)]
    e = spark.createDataFrame(pairs, "source_id string, target_id string")
    want, last = set(), {(a, b) for a, b in pairs if a and b}
    while last:
        want |= last
        last = {(s, b) for s, m in last for a, b in pairs if a == m and b} - want
    got = sorted(map(tuple, cp.closure(e, "doubling").collect()))
    assert got == sorted((s, t) for s, t in want if s != t) and len(got) > 9000


def test_doubling_without_edges(spark):
    none = spark.createDataFrame([("a", "a"), (None, "b")], "source_id string, target_id string")
    assert cp.closure(none, "doubling").collect() == []


def test_inheritance(spark):
    n = spark.createDataFrame([(x,) for x in "abcdefxyz"], "id string")
    p = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "d"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {r.id: (r.depth, r.root, r.is_deep) for r in cp.inheritance(n, p, most=64).collect()}
    assert got["a"] == (0, "a", False) and got["d"] == (3, "a", False) and got["e"] == (4, "a", True)
    assert got["z"] == (0, "z", False) and got["x"][1] is None


def test_packages(spark):
    classes = spark.createDataFrame([("A", "p.a", "class", True), ("B", "p.a", "interface", False), ("C", "p.b", "class", False), ("D", None, "class", False), ("E", " ", "class", False)], "id string, package string, kind string, is_abstract boolean")
    e = frames(spark, ["AC", "BC", "AB", "CD"])[1]
    got = {r.package: r for r in cp.package_coupling(classes, e).collect()}
    assert (got["p.a"].ca, got["p.a"].ce, got["p.a"].tce, got["p.a"].abstractness, got["p.a"].distance) == (0, 1, 2, 1.0, 1.0)
    assert (got["(default)"].classes, got["(default)"].ca, got["(default)"].instability) == (2, 1, 0.0)
    assert got["p.b"].concrete_classes == 1 and got["p.b"].instability == 0.5
    assert {r.package for r in cp.ancestors(classes.filter("package like 'p%'")).collect()} == {"p", "p.a", "p.b"}


def test_interfaces_and_chains(spark):
    n, e = frames(spark, ["AB", "BC"], "extends")
    e = e.union(frames(spark, ["AI", "CJ", "IK"], "implements")[1])
    n = spark.createDataFrame([(x,) for x in "ABCIJK"], "id string")
    got = {r.id: (r.direct, r.inherited, r.total) for r in cp.interface_counts(n, e).collect()}
    assert got["A"] == (1, 2, 3) and got["B"] == (0, 1, 1) and got["J"] == (0, 0, 0)
    chains = {r.chain for r in cp.dependency_chains(frames(spark, ["AB", "BC", "BD", "DB"])[1], 1, 5).collect()}
    assert chains == {"A -> B -> C"}


def test_chains_of_any_length(spark):
    from weftline.operators.coupling import dependency_chains

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n3", "n2"), ("a", "b")], "source_id string, target_id string")
    assert [tuple(r) for r in dependency_chains(edges).collect()] == [(" -> ".join(f"n{i}" for i in range(10)), 9)]
