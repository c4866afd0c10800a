"""Graphs, predicates, merges, tags, metrics, rules, logs and files on small hand-made frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import scores as sc
from weftline.functions import text as tx
from weftline.graph import Graph
from weftline.operators import merge as mg
from weftline.operators import metrics as mt
from weftline.operators import query as q
from weftline.operators import runlog as rl
from weftline.operators import tags as tg
from weftline.plans.rules import CyclicRules, Rule, apply_rules, levels
from weftline.schema import EDGES, NODES

T = dt.datetime(2024, 1, 1)


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, i, p, m, t, T, T) for i, k, p, m, t in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, k, {}, T) for a, b, k in rows], EDGES)


@pytest.fixture(scope="module")
def g(spark):
    return Graph(
        nodes(spark, ("a", "c", {"x.y": "1", "flag": None}, {"loc": 10.0}, ["t1", "t2"]), ("b", "c", {}, {"loc": 20.0, "cc": 3.0}, ["t2"]), ("d", "f", {"x.y": "2"}, {}, []), ("e", "f", None, None, None)),
        edges(spark, ("a", "b", "uses"), ("a", "b", "extends"), ("b", "d", "uses"), ("d", "gone", "uses"), ("e", "e", "uses")),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_predicates(g):
    n = g.nodes
    assert ids(q.by_types(n, "node_type", None)) == ids(q.by_types(n, "node_type", [])) == ["a", "b", "d", "e"]
    assert ids(n.filter(q.has_any_tag([]))) == ids(n.filter(q.has_all_tags([]))) == []
    assert ids(n.filter(q.has_tag("t1"))) == ["a"] and ids(n.filter(~q.has_tag("t1"))) == ["b", "d", "e"]
    assert ids(n.filter(q.has_any_tag(["t1", "t2"]))) == ["a", "b"] and ids(n.filter(q.has_all_tags(["t1", "t2"]))) == ["a"]
    assert ids(n.filter(q.has_property("x.y"))) == ["a", "d"] and ids(n.filter(q.has_property("x.y", "2"))) == ["d"]
    assert ids(n.filter(q.has_property("flag"))) == ["a"] and ids(n.filter(q.has_property("flag", "x"))) == []
    assert ids(q.query_nodes(n, "BY_TYPE", "f")) == ["d", "e"] and ids(q.query_nodes(n)) == ["a", "b", "d", "e"]
    with pytest.raises(ValueError):
        q.query_nodes(n, "BY_MOOD")
    assert ids(q.add_tag(n, "new", F.col("id") == "e").filter(q.has_tag("new"))) == ["e"]


def test_subgraphs(g):
    assert [(r.source_id, r.edge_type) for r in g.induced(["c"], ["uses"]).edges.collect()] == [("a", "uses")]
    assert g.resolved().edges.count() == 4 and g.induced().edges.count() == 4
    assert g.reversed().edges.filter("source_id = 'b' and target_id = 'a'").count() == 2
    groups = g.nodes.select("id", F.col("node_type").alias("group"))
    assert [tuple(r) for r in g.lifted(groups).collect()] == [("c", "f")]
    seen = {(r.source_id, r.target_id): r.direction for r in q.with_direction(g.edges, "b").collect()}
    assert seen == {("a", "b"): "incoming", ("b", "d"): "outgoing"}


def test_packages_and_paths(spark):
    d = spark.createDataFrame([("com.a",), ("com.a.b",), ("com.ab",), (None,)], "p string")
    assert [r.p for r in d.filter(q.in_packages(F.col("p"), ["com.a"])).collect()] == ["com.a", "com.a.b"]
    assert d.filter(q.in_packages(F.col("p"), [])).count() == 4
    assert tuple(q.filter_statistics(d, q.in_packages(F.col("p"), ["com.ab"])).first()) == (4, 1, 3)
    assert value(spark, q.package_of(F.lit("a.b.C"))) == "a.b" and value(spark, q.package_of(F.lit("C"))) is None
    assert value(spark, q.normal_path(F.lit("a\\\\b//c/./d/"))) == "a/b/c/d"
    assert value(spark, q.extension(F.lit("x/.hidden"))) == "" and value(spark, q.extension(F.lit("a.tar.GZ"))) == "gz"
    assert value(spark, q.is_archive(F.lit("lib/A.JAR"))) is True


@pytest.mark.parametrize(
    ("pattern", "hit", "miss"),
    [("*.class", "a/b/X.class", "a/X.classy"), ("target/", "a/target/x", "a/target"), ("/build", "build/x", "a/build/x"), ("a/**/z", "a/b/c/z", "b/a/z"), ("a/*/z", "a/b/z", "a/b/c/z"), ("f?o", "x/fxo", "x/f/o"), ("**/gen", "q/gen/x", "q/gene"), ("a+b", "a+b", "aab")],
)
def test_globs(spark, pattern, hit, miss):
    assert value(spark, q.ignored(F.lit(hit), [pattern])) and not value(spark, q.ignored(F.lit(miss), [pattern]))
    assert value(spark, q.ignored(F.lit("a/.git/x"), [])) and not value(spark, q.ignored(F.lit("a/.git/x"), [], hidden=False))


def test_merges(spark):
    d = spark.createDataFrame([("k", 1, "LOW", True, -5.0), ("k", 2, "odd", False, -2.0), ("k", None, None, None, None), ("z", None, None, None, None)], "k string, t int, level string, flag boolean, x double")
    assert {r.k: r.level for r in mg.first_wins(d, ["k"], "t").collect()} == {"k": "LOW", "z": None}
    assert {r.k: r.level for r in mg.last_wins(d, ["k"], "t").collect()} == {"k": "odd", "z": None}
    got = {r.k: (r.m, r.o, r.a, r.c) for r in d.groupBy("k").agg(mg.merge_max("x").alias("m"), mg.merge_or("flag").alias("o"), mg.merge_and("flag").alias("a"), mg.merge_complexity("level").alias("c")).collect()}
    assert got == {"k": (0.0, True, False, "MEDIUM"), "z": (0.0, False, False, "NONE")}


def test_upserts_and_deletes(spark, g):
    later = T + dt.timedelta(days=2)
    new = spark.createDataFrame([("a", "c", "new", {}, {}, [], later, later), ("n", "c", "n", {}, {}, [], later, later)], NODES)
    up = {r.id: r for r in mg.upsert_nodes(g.nodes, new).collect()}
    assert sorted(up) == ["a", "b", "d", "e", "n"] and up["a"].display_label == "new" and up["a"].created_at == T
    e = mg.insert_edges(g.edges, edges(spark, ("a", "b", "uses"), ("b", "a", "uses"), ("b", "a", "uses")))
    assert e.count() == 6
    n, e = mg.delete_nodes(g.nodes, g.edges, g.nodes.filter("id = 'b'"))
    assert ids(n) == ["a", "d", "e"] and sorted(r.source_id for r in e.collect()) == ["d", "e"]
    old = spark.createDataFrame([(1, "m")], "k int, c string").withColumn("md5", F.md5("c")).select("k", "md5")
    assert [r.k for r in mg.changed(old, spark.createDataFrame([(1, "m"), (2, "x")], "k int, c string"), "k", "c").collect()] == [2]


def test_patches_and_metrics(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    patch = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))
    assert value(spark, mg.patch_map(m, patch)) == {"b": "2", "c": "3"}
    assert value(spark, mg.patch_map(F.lit(None).cast("map<string,string>"), patch)) == {"c": "3"}
    d = F.create_map(F.lit("x"), F.lit(15.0))
    assert value(spark, mg.set_metric(d, "x", F.lit(150))) == {"x": 150.0}
    assert value(spark, mg.set_metric(d, "y", F.lit(2))) == {"x": 15.0, "y": 2.0}
    assert value(spark, mg.set_metric(d, "x", F.lit(None))) == {}


@pytest.mark.parametrize(
    ("flat", "nested"),
    [
        ({"name": 1, "version": 2}, {"name": 1, "version": 2}),
        ({"file.type": "x", "file.size": 3}, {"file": {"type": "x", "size": 3}}),
        ({"ejb.metadata.type": 1, "ejb.metadata.version": 2, "ejb.config.poolSize": 3}, {"ejb": {"metadata": {"type": 1, "version": 2}, "config": {"poolSize": 3}}}),
        ({"a.b.c.d.e": None}, {"a": {"b": {"c": {"d": {"e": None}}}}}),
        ({}, {}),
    ],
)
def test_nesting(spark, flat, nested):
    assert mg.nest_keys(flat) == nested and mg.flatten_keys(nested) == flat
    assert mg.nest_keys(None) == {}


def test_nested_json(spark):
    p = F.create_map(F.lit("a.b"), F.lit("1"), F.lit("c"), F.lit("2"))
    assert json.loads(value(spark, mg.nested_json(p, ["a.b", "a.x", "c"]))) == {"a": {"b": "1"}, "c": "2"}


def test_metric_statistics(spark, g):
    v = mt.metric_values(g.nodes)
    assert v.count() == 3 and mt.metric_values(g.nodes, ["cc"]).count() == 1 and mt.metric_values(g.nodes, ["none"]).count() == 0
    s = {r.metric: r for r in mt.metric_statistics(v).collect()}
    assert (s["loc"]["count"], s["loc"].min, s["loc"].max, s["loc"].avg, s["loc"].median, s["loc"].std_dev) == (2, 10.0, 20.0, 15.0, 15.0, 5.0)
    assert s["cc"].std_dev == 0.0
    five = spark.createDataFrame([(str(i), "loc", 100.0 * i) for i in range(1, 6)], "id string, metric string, value double")
    r = mt.metric_statistics(five).first()
    assert (r["count"], r["min"], r["max"], r["avg"], r["median"]) == (5, 100.0, 500.0, 300.0, 300.0)
    assert tuple(mt.graph_statistics(g).select("nodes", "node_types", "edges", "edge_types", "tagged_nodes").first()) == (4, 2, 5, 2, 2)
    assert tuple(mt.service_statistics(g, "c", "f").select("total_nodes", "total_edges", "class_nodes", "file_nodes").first()) == (4, 5, 2, 2)
    empty = Graph(g.nodes.limit(0), g.edges.limit(0))
    assert tuple(mt.service_statistics(empty).select("total_nodes", "total_edges", "class_nodes", "file_nodes").first()) == (0, 0, 0, 0)


def test_validation(spark):
    n = nodes(spark, ("a", "c", {"ok": "1", "bad key": "x", "n": None, "is_x": "maybe", "metrics.m": "many", "k" * 300: "1"}, {"loc": -1.0}, []))
    got = {(r.rule, r.key[:8]) for r in mt.validate(n, ["ok", "need"]).collect()}
    assert got == {("required", "need"), ("key_form", "bad key"), ("key_form", "kkkkkkkk"), ("null_value", "n"), ("not_boolean", "is_x"), ("not_numeric", "metrics."), ("negative", "loc")}


def test_tags(spark, g):
    assert [tuple(r) for r in tg.tag_statistics(g.nodes.filter("tags is not null")).collect()] == [("t2", 2), ("t1", 1)]
    assert {r.id: r.tags for r in tg.tags_to_array(g.nodes, tg.tag_rows(g.nodes)).collect()} == {"a": '["t1","t2"]', "b": '["t2"]', "d": "[]", "e": "[]"}
    names = spark.createDataFrame([("user_found",), ("USER_DETECTED",), ("user_config",), ("usr",), ("order",), (None,)], "name string")
    pairs = {(r.a, r.b): r.distance for r in tg.similar_pairs(names).collect()}
    assert pairs[("USER_DETECTED", "user_found")] == 0 and pairs[("user_config", "usr")] == 1 and ("order", "usr") not in pairs
    assert [tuple(r) for r in tg.pattern_pairs(names).collect()] == [("USER_DETECTED", "user_found")]
    assert {r.form for r in tg.normal_groups(names).collect()} == {"user"}
    assert [tuple(r) for r in tg.hits_union(g.nodes, ["t2", "t1"]).orderBy("id").collect()] == [("a", "t2"), ("b", "t2")]


def test_texts(spark):
    d = spark.createDataFrame([(None,), ("",), ("\n",), ("a\n\n// c\n * d\n /* e */\nb",), ("a\r\nb\r\rc\n",)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in d.select(tx.line_count(t), tx.blank_count(t), tx.comment_count(t)).collect()]
    assert got == [(0, 0, 0), (0, 0, 0), (1, 1, 0), (6, 1, 3), (4, 1, 0)]
    src = F.lit("package a.b;\nimport java.util.List;\nimport static x.Y.*;\nclass C {}\ninterface D")
    assert value(spark, tx.package_name(src)) == "a.b" and value(spark, tx.imports(src)) == ["java.util.List", "x.Y.*"]
    assert value(spark, tx.declared_types(src)) == ["C", "D"] and value(spark, tx.package_name(F.lit("x"))) is None
    assert value(spark, tx.type_kind(F.lit(0x2200), F.lit(True))) == "annotation" and value(spark, tx.type_kind(F.lit(1), F.lit(True))) == "record"
    assert [value(spark, tx.java_version(F.lit(n))) for n in (44, 45, 48, 49, 61)] == [None, "1.1", "1.4", "5", "17"]


def test_scores(spark):
    assert value(spark, sc.round_half_up(F.lit(-2.5), 0)) == -2.0 and value(spark, sc.round_half_up(F.lit(1.25), 1)) == 1.3
    assert value(spark, sc.interface_score(F.lit(2), F.lit(4), F.lit(1))) == 5.5 and value(spark, sc.interface_score(F.lit(10), F.lit(2), F.lit(0))) == 16.5
    assert [value(spark, sc.quality_score(F.lit(x))) for x in ("7", "85%", "0", "250", "none", "8.26")] == [7.0, 8.5, 1.0, 10.0, 5.0, 8.3]
    assert [value(spark, sc.state_level(F.lit(x))) for x in (8, 9, 24, 25)] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    assert value(spark, sc.type_score(*(F.lit(1),) * 6, F.lit(0))) == 0.0


def test_rules(spark, g):
    late, early = Rule("late", "metrics['loc'] > 5", ("c",), ("b",), {"loc": "metrics['loc'] + 1"}), Rule("early", "id != 'b'", ("b",), ("t2",))
    assert [[r.name for r in level] for level in levels([late, early])] == [["early"], ["late"]]
    got = {r.id: (r.tags, (r.metrics or {}).get("loc")) for r in apply_rules(g.nodes, [late, early]).collect()}
    assert got["a"] == (["b", "c", "t1", "t2"], 11.0) and got["b"] == (["t2"], 20.0) and got["e"] == ([], None)
    with pytest.raises(CyclicRules):
        levels([Rule("x", "true", ("p",), ("q",)), Rule("y", "true", ("q",), ("p",))])


def test_run_logs(spark):
    log = spark.createDataFrame([("r1", "f1", 1), ("r2", "f1", 2), ("r1", "f2", 3), ("r3", "f9", 4), ("r1", "f1", 5)], "rule string, file string, seq int")
    assert [tuple(r) for r in rl.first_triggers(log).orderBy("place").collect()] == [("r1", 1, "f1", 1), ("r2", 2, "f1", 2), ("r3", 4, "f9", 3)]
    assert {r.rule: (r.files, r.executions) for r in rl.progress(log).collect()} == {"r1": (2, 3), "r2": (1, 1), "r3": (1, 1)}
    assert tuple(rl.progress_summary(log).first()) == (3, 5, 3)
    calls = spark.createDataFrame([("1", T, "p", True, True, False, 3, 10.0, None, None), ("2", T, "p", False, False, True, 4, 20.0, 5, 0.5)], "call_id string, ts timestamp, pattern string, success boolean, script_generated boolean, cache_hit boolean, matches long, duration_ms double, tokens long, cost double")
    assert tuple(rl.calls_summary(calls).first()) == (2, 1, 1, 1, 1, 50.0, 1, 15.0, 7, 5, 0.5)
    assert tuple(rl.calls_summary(calls.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0, 0.0, 0, 0, 0.0)
    entries = spark.createDataFrame([(k, T + dt.timedelta(hours=h)) for k, h in (("a", 1), ("b", 3), ("c", 3), ("d", 2))], "k string, used timestamp")
    assert sorted(r.k for r in rl.least_recently_used(entries, 2, "used", "k").collect()) == ["a", "d"]


def test_truth(spark):
    d = spark.createDataFrame([(None, None, None), (0.0, "", []), (2.0, "False", ["x"])], "n double, s string, a array<string>")
    got = [tuple(r) for r in d.select(q.truthy("n", "number"), q.truthy("s", "string"), q.truthy("a", "array"), q.evaluate(d, "n > 1"), q.evaluate(d, "")).collect()]
    assert got == [(False, False, False, False, True), (False, False, False, False, True), (True, False, True, True, True)]
