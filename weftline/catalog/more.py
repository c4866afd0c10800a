"""Single metrics and lookups that other queries return together with others."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import scores as sc
from weftline.functions import text as tx
from weftline.operators import coupling as cp
from weftline.operators import merge as mg
from weftline.operators import query as q


@query("edge_by_id", "SELECT md5(source_id || '|' || target_id || '|' || edge_type) AS edge_id, source_id, target_id FROM edges")
def _(t):
    """Edges have no surrogate key; the digest of their triple is one."""
    return t.edges.select(F.md5(F.concat_ws("|", "source_id", "target_id", "edge_type")).alias("edge_id"), "source_id", "target_id")


@query("ce_transitive", "SELECT c.id, (SELECT count(*) FROM reach WHERE s = c.id AND t <> c.id) AS tce FROM classes c")
def _(t):
    return cp.transitive_coupling(t.classes, t.class_edges).select("id", "tce")


@query("ca_transitive", "SELECT c.id, (SELECT count(*) FROM reach WHERE t = c.id AND s <> c.id) AS tca FROM classes c")
def _(t):
    return cp.transitive_coupling(t.classes, t.class_edges).select("id", "tca")


_PAIRS = "SELECT DISTINCT a.package AS s, b.package AS t FROM class_edges e JOIN classes a ON a.id = e.source_id JOIN classes b ON b.id = e.target_id WHERE a.package <> b.package"
_DEGREES = f"WITH pk AS ({_PAIRS}), d AS (SELECT package, (SELECT count(*) FROM pk WHERE t = package) AS ca, (SELECT count(*) FROM pk WHERE s = package) AS ce, (count(*) FILTER (is_abstract OR kind = 'interface')) / count(*)::DOUBLE AS a FROM classes GROUP BY 1), m AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce)::DOUBLE END AS instability FROM d)"


@query("pkg_coupling", _DEGREES + " SELECT package, ca, ce, instability FROM m")
def _(t):
    return cp.package_coupling(t.classes, t.class_edges).select("package", "ca", "ce", "instability")


@query("main_seq_distance", _DEGREES + " SELECT package, round(abs(a + instability - 1.0), 9) AS distance FROM m")
def _(t):
    return cp.package_coupling(t.classes, t.class_edges).select("package", F.round("distance", 9).alias("distance"))


@query("inherit_root", "SELECT 's:' || s_suppkey AS id, 's:0' AS root FROM supplier")
def _(t):
    parents = t.class_edges.filter("edge_type = 'extends'").select(F.col("source_id").alias("id"), F.col("target_id").alias("parent"))
    return cp.inheritance(t.classes, parents).select("id", "root")


@query("sink_props_patch", "SELECT id, 'X' AS brand, properties['type'] AS type FROM nodes WHERE node_type = 'part'")
def _(t):
    patch = F.create_map(F.lit("brand"), F.lit("X"), F.lit("gone"), F.lit(None).cast("string"))
    p = t.nodes.filter("node_type = 'part'").select("id", mg.patch_map(F.col("properties"), patch).alias("p"))
    return p.select("id", F.col("p")["brand"].alias("brand"), F.col("p")["type"].alias("type"))


@query("fqn", "SELECT id, package AS package_name, 'Class' || key AS simple_name FROM classes")
def _(t):
    name = F.concat("package", F.lit(".Class"), F.col("key").cast("string"))
    return t.classes.select("id", q.package_of(name).alias("package_name"), q.simple_name(name).alias("simple_name"))


@query("annotation_count", "SELECT l_suppkey AS class, count(*) FILTER (l_linestatus = 'O') AS annotations, count(DISTINCT l_returnflag) FILTER (l_linestatus = 'O') AS kinds FROM lineitem GROUP BY 1")
def _(t):
    on = F.col("l_linestatus") == "O"
    return t["lineitem"].groupBy(F.col("l_suppkey").alias("class")).agg(F.count_if(on).alias("annotations"), F.countDistinct(F.when(on, F.col("l_returnflag"))).alias("kinds"))


@query("reply_labels", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS label FROM customer")
def _(t):
    """Labels parsed out of free replies; replies without a known one give null."""
    reply = F.concat(F.lit("I would say: "), F.lower("c_mktsegment"), F.lit(" (sure)"))
    return t["customer"].select("c_custkey", sc.reply_label(reply, ("BUILDING", "MACHINERY")).alias("label"))


@query("src_json_load", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t["events"].select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("line_totals", "SELECT source, sum(strlen(text))::BIGINT AS bytes, count(*) AS files FROM documents GROUP BY 1")
def _(t):
    return t["documents"].groupBy("source").agg(F.sum(tx.byte_count(F.col("text"))).alias("bytes"), F.count("*").alias("files"))
