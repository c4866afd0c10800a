"""Stored graphs, exports, call logs, streams, plans and files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import calls as cl
from weftline.sources import plans as pl
from weftline.sources import store
from weftline.streaming.flush import daily_stream, flush_calls
from tests.test_graph import edges, nodes
from weftline.graph import Graph


@pytest.fixture()
def log(spark):
    rows = [(str(i), dt.datetime(2024, 1 + i % 3, 1 + i % 28, i % 24), "p", i % 4 > 0, True, False, i, float(i), i, 0.5) for i in range(60)]
    return spark.createDataFrame(rows, cl.CALLS)


def test_graph_round_trip_and_pruning(spark, tmp_path):
    g = Graph(nodes(spark, ("a", "c", {"k": "v"}, {"m": 1.5}, ["t"]), ("b", "f", {}, {}, [])), edges(spark, ("a", "b", "uses"), ("a", "x", "uses"), ("b", "a", "has")))
    store.save_graph(g, path := str(tmp_path / "g"))
    back = store.load_graph(spark, path)
    assert back.nodes.count() == 2 and back.edges.count() == 2
    assert store.load_graph(spark, path, resolve=False).edges.count() == 3
    plan = store.load_graph(spark, path, ["c"], resolve=False).nodes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node_type" in plan
    r = back.nodes.filter("id = 'a'").first()
    assert r.properties == {"k": "v"} and r.metrics == {"m": 1.5} and r.tags == ["t"]


def test_exports(spark, tmp_path):
    g = Graph(nodes(spark, ('q"<,', "c", {}, {"m": 1.5}, ["t"]), ("b", "c", {}, {}, ["u", "t"])), edges(spark, ("b", 'q"<,', "uses")))
    store.write_pivoted_csv(g.nodes, str(tmp_path / "csv"), ["c"])
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/c")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("b", "c", "b", "true", "true", None), ('q"<,', "c", 'q"<,', "true", "false", "1.5")]
    store.write_graph_json(g, str(tmp_path / "json"))
    tags = {r.tag: (r.nodes, r.ids) for r in spark.read.json(str(tmp_path / "json/tags")).collect()}
    assert tags == {"t": (2, 'b,q"<,'), "u": (1, "b")}
    assert '<edge source="b" target="q&quot;&lt;,"/>' in {r.line for r in store.graphml_lines(g).collect()}
    assert '"b" -> "q\\"<,";' in {r.line for r in store.dot_lines(g).collect()}


def test_call_log(spark, log, tmp_path):
    path = str(tmp_path / "calls")
    cl.write_calls(log, path)
    assert sorted(map(tuple, cl.read_calls(spark, path).collect())) == sorted(map(tuple, log.collect()))
    part = cl.read_calls(spark, path, "2024-02-01", "2024-02-10 12:00:00")
    assert part.count() == log.filter("ts between timestamp '2024-02-01' and timestamp '2024-02-10 12:00:00'").count() > 0
    assert cl.drop_old_months(spark, path, "2024-03-15", 1) == ["2024-01"]
    assert cl.read_calls(spark, path).count() == log.filter("month(ts) > 1").count()


def test_streams(spark, log, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    log.limit(30).write.json(src)
    for _ in range(2):  # a second run finds nothing new
        flush_calls(spark, src, out, state).awaitTermination()
    assert cl.read_calls(spark, out).count() == 30
    log.subtract(log.limit(30)).write.mode("append").json(src)
    flush_calls(spark, src, out, state).awaitTermination()
    assert cl.read_calls(spark, out).count() == 60
    daily = daily_stream(spark.readStream.schema(cl.CALLS).json(src))
    q = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("total")).first()[0] == 60


def test_plans(spark):
    docs = {"main": {"name": "m", "includes": ["sub"], "phases": [{"name": "p2", "tasks": [{"id": "t", "blocks": [{"name": "b1", "type": "COMMAND"}, {"name": "b2"}]}]}]}, "sub": {"phases": [{"name": "p1", "tasks": [{"name": "t0", "blocks": [{"name": "b0"}]}]}]}, "loop": {"includes": ["loop"]}}
    rows = pl.plan_blocks(spark, [pl.resolve_includes("main", docs.__getitem__)]).collect()
    assert [(r.phase, r.task, r.block, r.phase_no) for r in rows] == [("p1", "t0", "b0", 0), ("p2", "t", "b1", 1), ("p2", "t", "b2", 1)]
    with pytest.raises(pl.CyclicInclude):
        pl.resolve_includes("loop", docs.__getitem__)


def test_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/X.java").write_text("class X {}\n")
    (tmp_path / "a/b/y.TXT").write_text("y")
    got = {r.name: r.text for r in store.read_files(spark, str(tmp_path)).collect()}
    assert got == {"X.java": "class X {}\n", "y.TXT": "y"}
    assert [r.name for r in store.read_files(spark, str(tmp_path), ["txt"]).collect()] == ["y.TXT"]
    assert json.dumps(sorted(got)) == '["X.java", "y.TXT"]'


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registered_exports_of_the_whole_graph(spark, sf_dir):
    from weftline.catalog import QUERIES
    from weftline.catalog.tables import Tables

    t = Tables(spark, sf_dir)
    n, e = t.nodes.count(), t.edges.count()
    for name in ("sink_graphml", "sink_dot"):
        assert {r["part"]: r["count"] for r in QUERIES[name](spark, sf_dir).groupBy("part").count().collect()} == {1: n, 2: e}
    csv = QUERIES["sink_csv_pivot"](spark, sf_dir)
    by_type = lambda df, c: {r[0]: r["count"] for r in df.groupBy(c).count().collect()}
    assert by_type(csv, "type") == by_type(t.nodes, "node_type") and len(by_type(csv, "type")) == 5


def test_class_and_package_records(spark, tmp_path):
    from weftline.sources.store import read_record_csv, write_record_csv

    rows = [("a", 'p "q", r', "class"), ("b", 'p "q", r', "interface"), ("c\nd", None, "enum"), ("a", "z", None), ("a", "z", None)]
    classes = spark.createDataFrame(rows, "id string, package string, kind string").withColumn("name", F.lit("extra"))
    write_record_csv(classes, str(tmp_path / "r"))
    got = [tuple(r) for r in read_record_csv(spark, str(tmp_path / "r")).collect()]
    want = [("class", i, p, k, None) for i, p, k in rows] + [("package", 'p "q", r', 'p "q", r', None, 2), ("package", None, None, None, 1), ("package", "z", "z", None, 2)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    write_record_csv(classes.limit(0), str(tmp_path / "none"))
    assert read_record_csv(spark, str(tmp_path / "none")).count() == 0
