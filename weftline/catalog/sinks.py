"""Upserts, deletes and exports: what a sink would hold, as a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import merge as mg
from weftline.operators import metrics as mt
from weftline.operators import tags as tg
from weftline.plans.scratch import Rounds
from weftline.sources import store

_NEW = "SELECT id, 'new ' || display_label AS display_label, created_at + INTERVAL 1 DAY AS created_at, updated_at + CASE WHEN k % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL (-1) HOUR END AS updated_at FROM born WHERE node_type = 'supplier' UNION ALL SELECT 'x' || id, display_label, created_at, updated_at FROM born WHERE node_type = 'nation'"


def _versions(t):
    """All nodes, and new observations of suppliers (every second one older) and of nations under new ids."""
    old = t.nodes.select("id", "display_label", "created_at", "updated_at")
    s = t.nodes.filter("node_type = 'supplier'").select("id", F.concat(F.lit("new "), "display_label").alias("display_label"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"), F.when(F.substring_index("id", ":", -1).cast("long") % 2 == 0, F.col("updated_at") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("updated_at") - F.expr("INTERVAL 1 HOUR")).alias("updated_at"))
    n = t.nodes.filter("node_type = 'nation'").select(F.concat(F.lit("x"), "id").alias("id"), "display_label", "created_at", "updated_at")
    return old, s.unionByName(n)


@query("sink_node_upsert", f"WITH a AS (SELECT id, display_label, created_at, updated_at, 0 AS fresh FROM born UNION ALL SELECT *, 1 FROM ({_NEW})) SELECT id, display_label, min(created_at) OVER (PARTITION BY id) AS created_at, updated_at FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, fresh DESC) = 1")
def _(t):
    return mg.upsert_nodes(*_versions(t))


@query("sink_node_insert", f"SELECT id FROM nodes UNION SELECT id FROM ({_NEW})")
def _(t):
    old, new = _versions(t)
    return old.select("id").union(mg.skip_existing(new, old, "id").select("id"))


@query("sink_node_update", f"SELECT n.id, coalesce(u.display_label, n.display_label) AS display_label FROM nodes n LEFT JOIN ({_NEW}) u USING (id)")
def _(t):
    old, new = _versions(t)
    return old.join(new.select("id", F.col("display_label").alias("label")), "id", "left").select("id", F.coalesce("label", "display_label").alias("display_label"))


@query("props_patch", "SELECT id, properties['segment'] AS segment, NULL::VARCHAR AS nation, 'yes' AS seen, 2::BIGINT AS n FROM nodes WHERE node_type = 'customer'")
def _(t):
    patch = F.create_map(F.lit("nation"), F.lit(None).cast("string"), F.lit("seen"), F.lit("yes"))
    c = t.nodes.filter("node_type = 'customer'").select("id", mg.patch_map(F.col("properties"), patch).alias("p"))
    return c.select("id", F.try_element_at("p", F.lit("segment")).alias("segment"), F.try_element_at("p", F.lit("nation")).alias("nation"), F.try_element_at("p", F.lit("seen")).alias("seen"), F.size("p").cast("long").alias("n"))


@query("sink_edge_insert", "SELECT source_id, target_id, edge_type FROM edges UNION SELECT target_id, source_id, 'contains' FROM edges WHERE edge_type = 'contains'")
def _(t):
    back = t.graph.reversed().edges.filter("edge_type = 'contains'")
    return mg.insert_edges(t.edges, back.unionByName(t.edges)).select("source_id", "target_id", "edge_type")


@query("sink_delete", "SELECT source_id, target_id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE list_contains(tags, 'negative')) AND target_id NOT IN (SELECT id FROM nodes WHERE list_contains(tags, 'negative'))")
def _(t):
    gone = t.nodes.filter(F.array_contains("tags", "negative"))
    return mg.delete_nodes(t.nodes, t.edges, gone)[1].select("source_id", "target_id")


@query("sink_delete_edge", "SELECT source_id, target_id, edge_type FROM edges WHERE NOT (edge_type = 'uses' AND source_id = 's:1')")
def _(t):
    """Edges deleted by their triple."""
    gone = t.edges.filter("edge_type = 'uses' and source_id = 's:1'")
    return mg.delete_edges(t.edges, gone).select("source_id", "target_id", "edge_type")


@query("sink_delete_edges_of_node", "SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN ('n:3', 's:2') AND target_id NOT IN ('n:3', 's:2')")
def _(t):
    """Edges deleted by either end; the nodes stay."""
    return mg.delete_edges_of(t.edges, t.nodes.filter("id in ('n:3', 's:2')")).select("source_id", "target_id", "edge_type")


@query("sink_delete_all", "SELECT 'edges' AS what, 0::BIGINT AS n UNION ALL SELECT 'nodes', 0::BIGINT")
def _(t):
    """Everything deleted in a saved graph: its folders are empty, its schema stays."""
    at = Rounds(t.spark, "graph").path
    store.save_graph(t.graph, at)
    store.delete_graph(t.spark, at)
    g = store.load_graph(t.spark, at)
    return g.edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")).unionByName(g.nodes.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")))


@query("csv_pivot", "SELECT id, node_type AS type, display_label AS label, list_contains(tags, 'cheap') AS tag_cheap, list_contains(tags, 'large') AS tag_large, list_contains(tags, 'rich') AS tag_rich, metrics['retailprice'] AS metric_retailprice, metrics['size'] AS metric_size FROM nodes WHERE node_type = 'part'")
def _(t):
    return mt.pivoted(t.nodes, "part", ["cheap", "large", "rich"], ["retailprice", "size"])


_TAGS, _METRICS = ("building", "cheap", "large", "negative", "rich"), ("acctbal", "retailprice", "size")
_TAG_SQL = ", ".join(f"CASE WHEN bool_or(list_contains(tags, '{x}')) OVER (PARTITION BY node_type) THEN coalesce(list_contains(tags, '{x}'), false) END AS tag_{x}" for x in _TAGS)
_METRIC_SQL = ", ".join(f"metrics['{x}'] AS metric_{x}" for x in _METRICS)


@query("sink_csv_pivot", f"SELECT id, node_type AS type, display_label AS label, {_TAG_SQL}, {_METRIC_SQL} FROM nodes")
def _(t):
    """The CSV folders of all node types, read back; a column that a type's header lacks is null."""
    at = Rounds(t.spark, "csv").path
    types = sorted(r[0] for r in t.nodes.select("node_type").distinct().collect())
    store.write_pivoted_csv(t.nodes, at, types)
    out = None
    for x in types:
        back = t.spark.read.option("header", True).option("escape", '"').csv(f"{at}/{x}")
        typed = [(f"tag_{c}", "boolean") for c in _TAGS] + [(f"metric_{c}", "double") for c in _METRICS]
        back = back.select("id", "type", "label", *[(F.col(c) if c in back.columns else F.lit(None)).cast(d).alias(c) for c, d in typed])
        out = back if out is None else out.unionByName(back)
    return out


@query("inverted_index", "SELECT tag, count(*) AS nodes, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, unnest(tags) AS tag FROM nodes) GROUP BY 1")
def _(t):
    return tg.inverted_index(t.nodes)


@query("sink_json_graph", "SELECT tag, count(*) AS nodes FROM (SELECT unnest(tags) AS tag FROM nodes) GROUP BY 1")
def _(t):
    at = Rounds(t.spark, "json").path
    store.write_graph_json(t.graph, at)
    return t.spark.read.schema("tag string, nodes long").json(f"{at}/tags")


@query("sink_project_json", "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def _(t):
    """The whole graph saved and loaded, edges resolved."""
    at = Rounds(t.spark, "graph").path
    store.save_graph(t.graph, at)
    return store.load_graph(t.spark, at).edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("sink_csv_records", "SELECT 'class' AS record, id AS name, package, kind, NULL::BIGINT AS classes FROM classes UNION ALL SELECT 'package', package, package, NULL, count(*) FROM classes GROUP BY package")
def _(t):
    """The CSV folders of class and package records, read back."""
    at = Rounds(t.spark, "records").path
    store.write_record_csv(t.classes, at)
    return store.read_record_csv(t.spark, at)


@query("sink_graphml", "SELECT 1 AS part, '<node id=\"' || id || '\"/>' AS line FROM nodes UNION ALL SELECT 2, '<edge source=\"' || source_id || '\" target=\"' || target_id || '\"/>' FROM edges")
def _(t):
    return store.graphml_lines(t.graph)


@query("sink_dot", "SELECT 1 AS part, '\"' || id || '\";' AS line FROM nodes UNION ALL SELECT 2, '\"' || source_id || '\" -> \"' || target_id || '\";' FROM edges")
def _(t):
    return store.dot_lines(t.graph)


@query("validate_properties", "SELECT id, rule, key FROM nodes, (VALUES ('required', 'owner'), ('not_boolean', 'is_open'), ('not_numeric', 'metrics.x')) AS v(rule, key) WHERE node_type = 'supplier' UNION ALL SELECT id, 'negative', 'acctbal' FROM nodes WHERE node_type = 'supplier' AND metrics['acctbal'] < 0")
def _(t):
    """Violations of nodes with broken properties; more of them are in the tests' fixture."""
    bad = t.nodes.filter("node_type = 'supplier'").withColumn("properties", F.map_concat("properties", F.create_map(F.lit("is_open"), F.lit("maybe"), F.lit("metrics.x"), F.lit("many"))))
    return mt.validate(bad, ["nation", "owner"])
