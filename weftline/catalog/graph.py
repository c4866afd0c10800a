"""Node, edge, tag, join, merge and coupling queries over the test graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import coupling as cp
from weftline.operators import merge as mg
from weftline.operators import metrics as mt
from weftline.operators import query as q
from weftline.operators import tags as tg

# --- scans ---------------------------------------------------------------------------


@query("src_h2_load", "SELECT id, display_label FROM nodes WHERE node_type IN ('supplier', 'nation')")
def _(t):
    return t.graph.of_types(["supplier", "nation"], ["contains"]).nodes.select("id", "display_label")


@query("src_edge_resolve", "SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE node_type IN ('supplier', 'nation')) AND target_id IN (SELECT id FROM nodes WHERE node_type IN ('supplier', 'nation'))")
def _(t):
    return t.graph.of_types(["supplier", "nation"]).resolved().edges.select("source_id", "target_id")


# --- predicates ------------------------------------------------------------------------


def _ids(df):
    return df.select("id")


@query("node_by_id", "SELECT id, display_label FROM nodes WHERE id = 's:7'")
def _(t):
    return t.nodes.filter("id = 's:7'").select("id", "display_label")


@query("node_exists", "SELECT count(*) > 0 AS found FROM nodes WHERE id = 'p:3'")
def _(t):
    return t.nodes.filter("id = 'p:3'").agg((F.count("*") > 0).alias("found"))


@query("node_by_type", "SELECT id, created_at FROM born WHERE node_type = 'part'")
def _(t):
    return q.newest_first(t.nodes.filter("node_type = 'part'"), "id").select("id", "created_at")


@query("nodes_by_type_set", "SELECT id FROM nodes WHERE node_type IN ('region', 'nation')")
def _(t):
    return _ids(q.by_types(t.nodes, "node_type", ["region", "nation"]))


@query("nodes_by_empty_type_set", "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def _(t):
    return q.by_types(t.nodes, "node_type", []).groupBy("node_type").agg(F.count("*").alias("n"))


@query("edges_by_type_set", "SELECT source_id, target_id FROM edges WHERE edge_type IN ('contains')")
def _(t):
    return q.by_types(t.edges, "edge_type", ["contains"]).select("source_id", "target_id")


@query("nodes_by_class", "SELECT id, kind FROM classes WHERE kind = 'interface'")
def _(t):
    return t.classes.filter("kind = 'interface'").select("id", "kind")


@query("node_all", "SELECT id, node_type, created_at FROM born")
def _(t):
    return t.nodes.orderBy("node_type", F.desc("created_at"), "id").select("id", "node_type", "created_at")


@query("edge_all", "SELECT source_id, target_id, edge_type FROM edges")
def _(t):
    return t.edges.orderBy("edge_type", F.desc("created_at"), "source_id", "target_id").select("source_id", "target_id", "edge_type")


@query("sort_type_created", "SELECT id, row_number() OVER (PARTITION BY node_type ORDER BY created_at DESC, id) AS place FROM born")
def _(t):
    w = Window.partitionBy("node_type").orderBy(F.desc("created_at"), "id")
    return t.nodes.select("id", F.row_number().over(w).cast("long").alias("place"))


@query("node_by_property", "SELECT id FROM nodes WHERE properties['segment'] = 'BUILDING'")
def _(t):
    return _ids(t.nodes.filter(q.has_property("segment", "BUILDING")))


@query("node_by_json_path", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def _(t):
    return t["events"].filter(F.get_json_object("props", "$.k") == "69").select("event_id")


@query("class_by_property", "SELECT id, properties['brand'] AS value, cardinality(properties) AS n_properties FROM nodes WHERE map_contains(properties, 'brand') AND properties['brand'] = 'Brand#12'")
def _(t):
    return t.nodes.filter(q.has_property("brand", "Brand#12")).select("id", F.col("properties")["brand"].alias("value"), F.size("properties").cast("long").alias("n_properties"))


@query("node_by_tag", "SELECT id FROM nodes WHERE list_contains(tags, 'negative')")
def _(t):
    return _ids(t.nodes.filter(q.has_tag("negative")))


@query("node_by_any_tags", "SELECT id FROM nodes WHERE list_has_any(tags, ['negative', 'large'])")
def _(t):
    return _ids(t.nodes.filter(q.has_any_tag(["negative", "large"])))


@query("node_by_no_tags", "SELECT id FROM nodes WHERE false")
def _(t):
    return _ids(t.nodes.filter(q.has_any_tag([])))


@query("node_by_all_tags", "SELECT id FROM nodes WHERE list_has_all(tags, ['large', 'rich'])")
def _(t):
    return _ids(t.nodes.filter(q.has_all_tags(["large", "rich"])))


@query("node_by_type_any_tags", "SELECT id FROM nodes WHERE node_type = 'customer' AND list_has_any(tags, ['rich', 'building'])")
def _(t):
    return _ids(q.query_nodes(t.nodes, "BY_TYPE_AND_TAGS", "customer", ["rich", "building"]))


@query("node_by_type_all_tags", "SELECT id FROM nodes WHERE node_type = 'customer' AND list_has_all(tags, ['rich', 'building'])")
def _(t):
    return _ids(q.query_nodes(t.nodes, "BY_TYPE_AND_TAGS", "customer", ["rich", "building"], "all"))


@query("graph_query_block", "SELECT id, display_label AS name, count(*) OVER () AS node_count FROM nodes WHERE list_has_any(tags, ['cheap'])")
def _(t):
    found = q.query_nodes(t.nodes, "BY_TAGS", tags=["cheap"])
    # the number is one row, joined to all
    return found.select("id", F.col("display_label").alias("name")).join(F.broadcast(found.agg(F.count("*").alias("node_count"))))


@query("class_by_fqn", "SELECT id, package || '.' || 'Class' || key AS fqn FROM classes WHERE package || '.' || 'Class' || key LIKE 'com.asia.%.Class7'")
def _(t):
    fqn = F.concat("package", F.lit(".Class"), F.col("key").cast("string"))
    return t.classes.withColumn("fqn", fqn).filter((q.simple_name(F.col("fqn")) == "Class7") & q.package_of(F.col("fqn")).startswith("com.asia.")).select("id", "fqn")


@query("file_by_path", "SELECT doc_id FROM files WHERE path LIKE 'src/main/en/%'")
def _(t):
    path = q.normal_path(F.concat(F.regexp_replace("path", "/", "//"), F.lit("/")))
    return t.files.withColumn("p", path).filter(F.col("p").startswith("src/main/en/")).select("doc_id")


@query("edge_by_type", "SELECT source_id, target_id FROM edges WHERE edge_type = 'uses'")
def _(t):
    return t.edges.filter("edge_type = 'uses'").select("source_id", "target_id")


@query("edge_by_source", "SELECT target_id, edge_type FROM edges WHERE source_id = 's:3'")
def _(t):
    return t.edges.filter("source_id = 's:3'").select("target_id", "edge_type")


@query("edge_by_target", "SELECT source_id, edge_type FROM edges WHERE target_id = 'n:3'")
def _(t):
    return t.edges.filter("target_id = 'n:3'").select("source_id", "edge_type")


@query("edge_by_triple", "SELECT count(*) AS n FROM edges WHERE source_id = 's:3' AND edge_type = 'contains' AND target_id LIKE 'n:%'")
def _(t):
    return t.edges.filter("source_id = 's:3' and edge_type = 'contains' and target_id like 'n:%'").agg(F.count("*").alias("n"))


@query("edges_touching", "SELECT source_id, target_id FROM edges WHERE source_id = 'n:4' OR target_id = 'n:4'")
def _(t):
    return q.touching(t.edges, "n:4").select("source_id", "target_id")


@query("edge_direction", "SELECT source_id, target_id, CASE WHEN source_id = 'n:4' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE source_id = 'n:4' OR target_id = 'n:4'")
def _(t):
    return q.with_direction(t.edges, "n:4").select("source_id", "target_id", "direction")


@query("pkg_prefix_filter", "SELECT id, package FROM classes WHERE package = 'com.asia' OR package LIKE 'com.asia.%' OR package LIKE 'com.europe.france' OR package LIKE 'com.europe.france.%'")
def _(t):
    return t.classes.filter(q.in_packages(F.col("package"), ["com.asia", "com.europe.france"])).select("id", "package")


@query("pkg_filter_stats", "SELECT count(*) AS total, count(*) FILTER (package LIKE 'com.asia.%') AS kept, count(*) FILTER (package NOT LIKE 'com.asia.%') AS dropped FROM classes")
def _(t):
    return q.filter_statistics(t.classes, q.in_packages(F.col("package"), ["com.asia"]))


@query("app_class_tag", "SELECT id, CASE WHEN package LIKE 'com.america.%' THEN 'application' ELSE '' END AS tags FROM classes")
def _(t):
    c = t.classes.withColumn("tags", F.expr("array()").cast("array<string>"))
    return q.add_tag(c, "application", q.in_packages(F.col("package"), ["com.america"])).select("id", F.array_join("tags", ",").alias("tags"))


@query("subpackage_test", "SELECT id, len(string_split(package, '.'))::INT AS depth, string_split(package, '.')[3] AS simple, starts_with(package, 'com.asia.') AS below FROM classes")
def _(t):
    p = F.col("package")
    return t.classes.select("id", q.depth(p).alias("depth"), q.simple_name(p).alias("simple"), p.startswith("com.asia.").alias("below"))


@query("class_metrics_lookup", "SELECT id, cardinality(metrics) AS n_metrics, metrics['size'] AS size, array_to_string(tags, ',') AS tags FROM nodes WHERE id = 'p:11'")
def _(t):
    return t.nodes.filter("id = 'p:11'").select("id", F.size("metrics").cast("long").alias("n_metrics"), F.col("metrics")["size"].alias("size"), F.array_join("tags", ",").alias("tags"))


@query("tag_guard", "SELECT id, metrics['acctbal'] * 2 AS doubled FROM nodes WHERE list_has_all(tags, ['rich', 'building'])")
def _(t):
    return t.nodes.filter(q.has_all_tags(["rich", "building"])).select("id", (F.col("metrics")["acctbal"] * 2).alias("doubled"))


@query("expr_eval", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity <> 0 AND l_returnflag <> '' AND (l_discount > 0.05 OR l_tax = 0) AS truth, true AS blank FROM lineitem")
def _(t):
    l = t["lineitem"]
    truth = q.truthy("l_quantity", "number") & q.truthy("l_returnflag", "string") & q.evaluate(l, "l_discount > 0.05 or l_tax = 0")
    return l.select("l_orderkey", "l_linenumber", "l_quantity", truth.alias("truth"), q.evaluate(l, " ").alias("blank"))


# --- joins -------------------------------------------------------------------------------


@query("graph_induce", "SELECT source_id, target_id FROM edges WHERE edge_type = 'uses' AND source_id IN (SELECT id FROM nodes WHERE list_contains(tags, 'rich')) AND target_id IN (SELECT id FROM nodes WHERE list_contains(tags, 'rich'))")
def _(t):
    from weftline.graph import Graph

    return Graph(t.nodes.filter(q.has_tag("rich")), t.edges.filter("edge_type = 'uses'")).resolved().edges.select("source_id", "target_id")


@query("edge_enrich", "SELECT e.source_id, e.target_id, s.display_label AS source_label, coalesce(d.display_label, 'unknown') AS target_label FROM edges e JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes d ON d.id = e.target_id WHERE e.edge_type = 'contains'")
def _(t):
    n = t.nodes.select("id", "display_label")
    e = t.edges.filter("edge_type = 'contains'").select("source_id", "target_id")
    e = e.join(n.toDF("source_id", "source_label"), "source_id").join(n.toDF("target_id", "target_label"), "target_id", "left")
    return e.select("source_id", "target_id", "source_label", F.coalesce("target_label", F.lit("unknown")).alias("target_label"))


@query("edge_lift", "SELECT DISTINCT a.package AS source_id, b.package AS target_id FROM class_edges e JOIN classes a ON a.id = e.source_id JOIN classes b ON b.id = e.target_id WHERE a.package <> b.package")
def _(t):
    from weftline.graph import Graph

    return Graph(t.classes, t.class_edges).lifted(t.classes.select("id", F.col("package").alias("group")))


@query("tag_prod_cons", "SELECT p.rule AS producer, c.rule AS consumer, string_agg(DISTINCT p.tag, ',' ORDER BY p.tag) AS tags FROM made p JOIN need c USING (tag) WHERE p.rule <> c.rule GROUP BY 1, 2")
def _(t):
    return tg.producers_consumers(*t.rule_tags)


@query("unused_tags", "SELECT DISTINCT tag FROM made WHERE tag NOT IN (SELECT tag FROM need)")
def _(t):
    return tg.unused_tags(*t.rule_tags)


@query("multi_producer", "SELECT tag, count(*) AS producers, string_agg(rule, ',' ORDER BY rule) AS rules FROM made GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return tg.multi_producers(t.rule_tags[0])


_FORM = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(lower({0}), '[._-]', '', 'g'), 'detected?', '', 'g'), 'found', ''), 'usage', ''), 'used', ''), 'pattern', ''), 'template', ''), 'config', ''), 'configuration', ''),
'impl', ''), 'implementation', ''), 'mgmt', ''), 'management', ''), 'svc', ''), 'service', ''), 's$', ''), '[0-9]+', '', 'g'))"""


@query("sim_pairs", f"WITH f AS (SELECT name, {_FORM.format('name')} AS form FROM names) SELECT a.name AS a, b.name AS b, levenshtein(a.form, b.form)::INT AS distance FROM f a, f b WHERE a.name < b.name AND levenshtein(a.form, b.form) <= greatest(1, least(length(a.form), length(b.form)) // 3)")
def _(t):
    return tg.similar_pairs(t.names)


_WORDS = "('DETECTED', 'FOUND'), ('DETECTOR', 'FINDER'), ('USAGE', 'USED'), ('PATTERN', 'TEMPLATE'), ('CONFIG', 'CONFIGURATION'), ('IMPL', 'IMPLEMENTATION'), ('MGMT', 'MANAGEMENT'), ('SVC', 'SERVICE')"
_NAMED = "SELECT DISTINCT replace(upper(p_brand), '#', '_') || (['_SVC', '_SERVICE', '_USAGE', '_USED', '_IMPL_2', '_IMPLEMENTATION', '_MGMT', '_MANAGEMENT_DB', '_JDBC_DETECTOR', '_DATABASE_FINDER', '_TX_CONFIG', '_TRANSACTION', '_WEBAPP', '_EJB_HOME'])[p_size % 14 + 1] AS name FROM part"


def _named(t):
    """Brands with words that have a partner or a context."""
    ends = ("_SVC", "_SERVICE", "_USAGE", "_USED", "_IMPL_2", "_IMPLEMENTATION", "_MGMT", "_MANAGEMENT_DB", "_JDBC_DETECTOR", "_DATABASE_FINDER", "_TX_CONFIG", "_TRANSACTION", "_WEBAPP", "_EJB_HOME")
    end = F.element_at(F.array(*map(F.lit, ends)), F.col("p_size") % 14 + 1)
    return t["part"].select(F.concat(F.replace(F.upper("p_brand"), F.lit("#"), F.lit("_")), end).alias("name")).distinct()


@query("pattern_pairs", f"WITH n AS (SELECT * FROM names UNION {_NAMED}), w AS (SELECT * FROM (VALUES {_WORDS}) AS v(x, y)), f AS (SELECT x, y, name, contains(name, x) AS hx, contains(name, y) AS hy, replace(replace(name, x, ''), y, '') AS base FROM n, w), g AS (SELECT *, {_FORM.format('base')} AS form FROM f) SELECT DISTINCT a.name AS a, b.name AS b FROM g a JOIN g b USING (x, y, form) WHERE a.name < b.name AND (a.hx AND b.hy OR a.hy AND b.hx)")
def _(t):
    return tg.pattern_pairs(t.names.union(_named(t)).distinct(), any_case=False)


@query("insp_dups", f"SELECT {_FORM.format('name')} AS form, string_agg(name, ',' ORDER BY name) AS names FROM names GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return tg.normal_groups(t.names)


_CONTEXT = """WITH n AS ({named}), c AS (
  SELECT 'ejb_context' AS context, name, replace(replace(replace(replace(replace(name, 'ENTERPRISE_BEAN', ''), 'MESSAGE_DRIVEN', ''), 'SESSION_BEAN', ''), 'ENTITY_BEAN', ''), 'EJB', '') AS rest FROM n WHERE regexp_matches(upper(name), 'EJB|ENTERPRISE_BEAN|SESSION_BEAN|ENTITY_BEAN|MESSAGE_DRIVEN')
  UNION ALL SELECT 'web_context', name, replace(replace(replace(replace(replace(name, 'SERVLET', ''), 'WEBAPP', ''), 'HTTP', ''), 'JSP', ''), 'WEB', '') FROM n WHERE regexp_matches(upper(name), 'SERVLET|JSP|WEB|HTTP|WEBAPP')
  UNION ALL SELECT 'data_context', name, replace(replace(replace(replace(replace(replace(name, 'HIBERNATE', ''), 'DATABASE', ''), 'JDBC', ''), 'JPA', ''), 'SQL', ''), 'DB', '') FROM n WHERE regexp_matches(upper(name), 'DATABASE|DB|SQL|JDBC|JPA|HIBERNATE')
  UNION ALL SELECT 'config_context', name, replace(replace(replace(replace(replace(name, 'CONFIGURATION', ''), 'PROPERTIES', ''), 'SETTINGS', ''), 'CONFIG', ''), 'PARAMS', '') FROM n WHERE regexp_matches(upper(name), 'CONFIG|CONFIGURATION|PROPERTIES|SETTINGS|PARAMS')
  UNION ALL SELECT 'transaction_context', name, replace(replace(replace(replace(replace(name, 'TRANSACTIONAL', ''), 'TRANSACTION', ''), 'ROLLBACK', ''), 'COMMIT', ''), 'TX', '') FROM n WHERE regexp_matches(upper(name), 'TRANSACTION|TX|TRANSACTIONAL|COMMIT|ROLLBACK')
), f AS (SELECT *, {form} AS form FROM c)
SELECT a.context, a.name AS a, b.name AS b, levenshtein(a.form, b.form)::INT AS distance FROM f a JOIN f b USING (context) WHERE a.name < b.name AND levenshtein(a.form, b.form) <= greatest(1, least(length(a.form), length(b.form)) // 3)"""


@query("ctx_pairs", _CONTEXT.format(named=_NAMED, form=_FORM.format("rest")))
def _(t):
    return tg.context_pairs(_named(t))


@query("skip_existing", "SELECT id FROM nodes WHERE node_type = 'part' AND id NOT IN (SELECT target_id FROM edges WHERE edge_type = 'uses' AND source_id < 's:5')")
def _(t):
    known = t.edges.filter("edge_type = 'uses' and source_id < 's:5'").select(F.col("target_id").alias("id")).distinct()
    return mg.skip_existing(t.nodes.filter("node_type = 'part'").select("id"), known, "id")


@query("stale_results", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE m IS NULL OR m < TIMESTAMP '1998-01-01'")
def _(t):
    items = t["customer"].select("c_custkey", F.lit("1998-01-01").cast("timestamp").alias("modified_at"))
    return mg.stale(items, t["orders"].select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("executed_at")), "c_custkey").select("c_custkey")


@query("imported_stub", "SELECT DISTINCT target_id AS id, 'imported_class' AS node_type FROM edges WHERE target_id NOT IN (SELECT id FROM nodes WHERE node_type <> 'part')")
def _(t):
    return cp.missing_targets(t.nodes.filter("node_type != 'part'"), t.edges)


@query("class_to_file", "SELECT id, path FROM classes JOIN files ON doc_id = key")
def _(t):
    return t.classes.join(t.files.select(F.col("doc_id").alias("key"), "path"), "key").select("id", "path")


@query("class_to_bean", "SELECT p_brand AS bean_class, count(*) AS beans FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t["part"].groupBy(F.col("p_brand").alias("bean_class")).agg(F.count("*").alias("beans")).filter("beans > 1")


# --- counts and metrics ------------------------------------------------------------------


@query("count_nodes", "SELECT node_type, count(*) AS n FROM nodes GROUP BY 1")
def _(t):
    return t.nodes.groupBy("node_type").agg(F.count("*").alias("n"))


@query("count_edges", "SELECT edge_type, count(*) AS n FROM edges GROUP BY 1")
def _(t):
    return t.edges.groupBy("edge_type").agg(F.count("*").alias("n"))


@query("count_by_tag", "SELECT count(*) AS n FROM nodes WHERE list_contains(tags, 'rich')")
def _(t):
    return t.nodes.filter(q.has_tag("rich")).agg(F.count("*").alias("n"))


@query("graph_statistics", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT node_type) FROM nodes) AS node_types, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT edge_type) FROM edges) AS edge_types, (SELECT count(*) FROM nodes WHERE len(tags) > 0) AS tagged_nodes")
def _(t):
    return mt.graph_statistics(t.graph)


@query("graph_stats_by_type", "SELECT 'node' AS element, node_type AS type, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY 2")
def _(t):
    return mt.statistics_by_type(t.graph)


@query("service_statistics", "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM nodes WHERE node_type = 'supplier') AS class_nodes, (SELECT count(*) FROM nodes WHERE node_type = 'part') AS file_nodes")
def _(t):
    return mt.service_statistics(t.graph, "supplier", "part")


@query("tag_statistics", "SELECT tag, count(*) AS nodes FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM nodes) GROUP BY 1")
def _(t):
    return tg.tag_statistics(t.nodes)


@query("tag_distinct", "SELECT DISTINCT unnest(tags) AS tag FROM nodes")
def _(t):
    return tg.tag_rows(t.nodes).select("tag").distinct()


@query("tag_crud", "SELECT id, array_to_string(list_sort(list_distinct(list_append(list_filter(tags, lambda x: x <> 'cheap'), 'seen'))), ',') AS tags FROM nodes WHERE node_type = 'part'")
def _(t):
    n = t.nodes.filter("node_type = 'part'").withColumn("tags", F.array_remove("tags", "cheap"))
    return q.add_tag(n, "seen", F.lit(True)).select("id", F.array_join("tags", ",").alias("tags"))


@query("tags_to_array", """SELECT id, '[' || coalesce(string_agg('"' || tag || '"', ',' ORDER BY tag), '') || ']' AS tags FROM nodes LEFT JOIN (SELECT DISTINCT id, unnest(tags) AS tag FROM nodes) t USING (id) GROUP BY 1""")
def _(t):
    return tg.tags_to_array(t.nodes, tg.tag_rows(t.nodes))


@query("metric_values", "SELECT id, metric, value FROM (SELECT id, unnest(map_keys(metrics)) AS metric, unnest(map_values(metrics)) AS value FROM nodes) WHERE metric IN ('size', 'acctbal')")
def _(t):
    return mt.metric_values(t.nodes, ["size", "acctbal"])


@query("metric_stats", "SELECT metric, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, median(value) AS median, round(stddev_pop(value), 6) AS std_dev FROM (SELECT unnest(map_keys(metrics)) AS metric, unnest(map_values(metrics)) AS value FROM nodes) GROUP BY 1")
def _(t):
    s = mt.metric_statistics(mt.metric_values(t.nodes))
    return s.withColumns({c: F.round(c, 6) for c in ("avg", "std_dev")})


@query("metric_names", "SELECT DISTINCT unnest(map_keys(metrics)) AS metric FROM nodes")
def _(t):
    return t.nodes.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()


@query("outliers", "WITH v AS (SELECT id, unnest(map_keys(metrics)) AS metric, unnest(map_values(metrics)) AS value FROM nodes), s AS (SELECT metric, avg(value) AS a, stddev_pop(value) AS d FROM v GROUP BY 1) SELECT id, metric, value FROM v JOIN s USING (metric) WHERE abs(value - a) > 1.7 * d")
def _(t):
    return mt.outliers(mt.metric_values(t.nodes), 1.7)


@query("edge_type_counts", "SELECT direction, edge_type, count(*) AS n FROM (SELECT edge_type, CASE WHEN source_id = 'n:4' THEN 'outgoing' ELSE 'incoming' END AS direction FROM edges WHERE source_id = 'n:4' OR target_id = 'n:4') GROUP BY 1, 2")
def _(t):
    return q.with_direction(t.edges, "n:4").groupBy("direction", "edge_type").agg(F.count("*").alias("n"))


@query("pkg_counts", "SELECT package, count(*) AS classes, count(*) FILTER (kind = 'interface') AS interfaces, count(*) FILTER (is_abstract AND kind <> 'interface') AS abstract_classes, count(*) FILTER (NOT is_abstract AND kind <> 'interface') AS concrete_classes FROM classes GROUP BY 1")
def _(t):
    return cp.package_counts(t.classes)


_HIERARCHY = "SELECT DISTINCT array_to_string(string_split(package, '.')[1:i], '.') AS package FROM classes, (SELECT unnest([1, 2, 3]) AS i)"


@query("inherit_pkgs", _HIERARCHY)
def _(t):
    return cp.ancestors(t.classes)


@query("pkg_discovery_stats", f"WITH h AS ({_HIERARCHY}), c AS (SELECT package, count(*) AS n FROM classes GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (c.n IS NULL) AS empty, max(len(string_split(h.package, '.')))::INT AS max_depth, round(sum(coalesce(c.n, 0)) / count(*)::DOUBLE, 6) AS mean_classes FROM h LEFT JOIN c USING (package)")
def _(t):
    h = cp.ancestors(t.classes).join(cp.package_counts(t.classes).select("package", "classes"), "package", "left")
    n = F.count("*")
    return h.agg(n.alias("total"), F.count_if(F.col("classes").isNull()).alias("empty"), F.max(q.depth(F.col("package"))).alias("max_depth"), F.round(F.coalesce(F.sum("classes"), F.lit(0)) / n, 6).alias("mean_classes"))


# --- coupling ----------------------------------------------------------------------------

_DEGREES = "SELECT c.id, (SELECT count(*) FROM class_edges e WHERE e.target_id = c.id) AS ca, (SELECT count(*) FROM class_edges e WHERE e.source_id = c.id) AS ce FROM classes c"


@query("coupling_direct", f"WITH d AS ({_DEGREES}) SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce)::DOUBLE END AS instability FROM d")
def _(t):
    return cp.direct_coupling(t.classes, t.class_edges)


@query("ca_direct", "SELECT id, (SELECT count(*) FROM edges e WHERE e.target_id = n.id AND edge_type = 'uses') AS ca FROM nodes n")
def _(t):
    return cp.degrees(t.nodes, t.edges).select("id", "ca")


@query("ce_direct", "SELECT id, (SELECT count(*) FROM edges e WHERE e.source_id = n.id AND edge_type = 'uses') AS ce FROM nodes n")
def _(t):
    return cp.degrees(t.nodes, t.edges).select("id", "ce")


@query("instability", f"WITH d AS ({_DEGREES}) SELECT id, CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce)::DOUBLE END AS instability FROM d")
def _(t):
    return cp.direct_coupling(t.classes, t.class_edges).select("id", "instability")


@query("coupling_transitive", "SELECT c.id, (SELECT count(*) FROM reach WHERE t = c.id AND s <> c.id) AS tca, (SELECT count(*) FROM reach WHERE s = c.id AND t <> c.id) AS tce FROM classes c")
def _(t):
    return cp.transitive_coupling(t.classes, t.class_edges)


@query("closure_doubling", "SELECT s AS source_id, t AS target_id FROM reach WHERE s <> t")
def _(t):
    return cp.closure(t.class_edges, "doubling")


_PAIRS = "SELECT DISTINCT a.package AS s, b.package AS t FROM class_edges e JOIN classes a ON a.id = e.source_id JOIN classes b ON b.id = e.target_id WHERE a.package <> b.package"
_PACKAGES = f"""WITH RECURSIVE pk AS ({_PAIRS}), pr AS (SELECT s, t FROM pk UNION SELECT pr.s, pk.t FROM pr JOIN pk ON pk.s = pr.t),
n AS (SELECT package, count(*) AS classes, count(*) FILTER (kind = 'interface') AS interfaces, count(*) FILTER (is_abstract AND kind <> 'interface') AS abstract_classes FROM classes GROUP BY 1),
d AS (SELECT n.*, (SELECT count(*) FROM pk WHERE t = package) AS ca, (SELECT count(*) FROM pk WHERE s = package) AS ce,
  (SELECT count(*) FROM pr WHERE t = package AND s <> package) AS tca, (SELECT count(*) FROM pr WHERE s = package AND t <> package) AS tce FROM n),
m AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce)::DOUBLE END AS instability, (abstract_classes + interfaces) / classes::DOUBLE AS abstractness FROM d)"""


@query("package_coupling", _PACKAGES + " SELECT package, ca, ce, tca, tce, instability FROM m")
def _(t):
    return cp.package_coupling(t.classes, t.class_edges).select("package", "ca", "ce", "tca", "tce", "instability")


@query("main_sequence", _PACKAGES + " SELECT package, abstractness, round(abs(abstractness + instability - 1.0), 9) AS distance FROM m")
def _(t):
    return cp.package_coupling(t.classes, t.class_edges).select("package", "abstractness", F.round("distance", 9).alias("distance"))


@query("pkg_edges", _PAIRS)
def _(t):
    from weftline.graph import Graph

    return Graph(t.classes, t.class_edges).lifted(t.classes.select("id", F.col("package").alias("group"))).toDF("s", "t")


@query("abstractness", "SELECT package, (count(*) FILTER (is_abstract OR kind = 'interface')) / count(*)::DOUBLE AS abstractness FROM classes GROUP BY 1")
def _(t):
    return cp.package_counts(t.classes).select("package", cp.abstractness().alias("abstractness"))


@query("inherit_depth", "WITH RECURSIVE up AS (SELECT s_suppkey AS k, s_suppkey AS a, 0 AS depth FROM supplier UNION ALL SELECT k, a // 2, depth + 1 FROM up WHERE a > 0) SELECT 's:' || k AS id, max(depth)::BIGINT AS depth, 's:0' AS root, max(depth) > 3 AS is_deep FROM up GROUP BY k")
def _(t):
    parents = t.class_edges.filter("edge_type = 'extends'").select(F.col("source_id").alias("id"), F.col("target_id").alias("parent"))
    return cp.inheritance(t.classes, parents)


@query(
    "iface_counts",
    """WITH RECURSIVE x AS (SELECT * FROM class_edges WHERE edge_type <> 'uses'), up AS (SELECT source_id AS s, target_id AS t FROM x UNION SELECT up.s, x.target_id FROM up JOIN x ON x.source_id = up.t),
i AS (SELECT DISTINCT target_id FROM x WHERE edge_type = 'implements'), d AS (SELECT source_id AS id, count(DISTINCT target_id) AS direct FROM x WHERE edge_type = 'implements' GROUP BY 1),
a AS (SELECT s AS id, count(*) AS total FROM up WHERE t IN (SELECT * FROM i) AND s <> t GROUP BY 1)
SELECT c.id, coalesce(direct, 0) AS direct, coalesce(total, 0) - coalesce(direct, 0) AS inherited, coalesce(total, 0) AS total FROM classes c LEFT JOIN d ON d.id = c.id LEFT JOIN a ON a.id = c.id""",
)
def _(t):
    return cp.interface_counts(t.classes, t.class_edges)


@query(
    "dep_chains",
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id AS s, target_id AS t FROM edges WHERE edge_type = 'contains'), p AS (
SELECT s, t AS here, [s, t] AS path, 1 AS length FROM e WHERE s NOT IN (SELECT t FROM e)
UNION ALL SELECT p.s, e.t, list_append(path, e.t), length + 1 FROM p JOIN e ON e.s = p.here WHERE NOT list_contains(path, e.t) AND length < 6)
SELECT array_to_string(path, ' -> ') AS chain, length::INT AS length FROM p WHERE here NOT IN (SELECT s FROM e) AND length >= 2""",
)
def _(t):
    return cp.dependency_chains(t.edges.filter("edge_type = 'contains'"))


@query("static_dep_graph", "SELECT target_id AS dependency, edge_type FROM class_edges WHERE source_id = 's:9'")
def _(t):
    return t.class_edges.filter("source_id = 's:9'").select(F.col("target_id").alias("dependency"), "edge_type")


@query("type_edges", "SELECT source_id, target_id, 'uses' AS edge_type, min(edge_type) AS relationship_kind FROM class_edges WHERE source_id <> target_id GROUP BY 1, 2")
def _(t):
    r = t.class_edges.withColumnRenamed("edge_type", "relation").withColumn("position", F.lit(0))
    return cp.relation_edges(r)


# --- merge policies ----------------------------------------------------------------------


@query("first_wins", "SELECT id, label, seq FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at, seq) = 1")
def _(t):
    return mg.first_wins(t.versions, ["id"], "seen_at", "seq").select("id", "label", "seq")


@query("last_wins", "SELECT id, label, seq FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, seq) = 1")
def _(t):
    return mg.last_wins(t.versions, ["id"], "seen_at", "seq").select("id", "label", "seq")


@query("keep_latest", "SELECT id, label, max(seq) AS seq FROM versions GROUP BY 1, 2")
def _(t):
    return mg.last_wins(t.versions, ["id", "label"], "seq").select("id", "label", "seq")


@query("merge_max", "SELECT id, greatest(max(value), 0) AS value FROM versions GROUP BY 1")
def _(t):
    return t.versions.groupBy("id").agg(mg.merge_max("value").alias("value"))


@query("merge_or", "SELECT id, bool_or(flag) AS flag FROM versions GROUP BY 1")
def _(t):
    return t.versions.groupBy("id").agg(mg.merge_or("flag").alias("flag"))


@query("merge_and", "SELECT id, bool_and(flag) AS flag FROM versions GROUP BY 1")
def _(t):
    return t.versions.groupBy("id").agg(mg.merge_and("flag").alias("flag"))


@query("merge_complexity", "SELECT id, (['NONE', 'LOW', 'MEDIUM', 'HIGH'])[max(CASE WHEN level IS NULL THEN 0 WHEN level = 'LOW' THEN 1 WHEN level = 'HIGH' THEN 3 ELSE 2 END) + 1] AS level FROM versions GROUP BY 1")
def _(t):
    return t.versions.groupBy("id").agg(mg.merge_complexity("level").alias("level"))


@query("top_producers", "SELECT rule, count(*) AS uses FROM made GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return tg.top(t.rule_tags[0], "rule", 5)


@query("top_consumers", "SELECT rule, count(*) AS uses FROM need GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return tg.top(t.rule_tags[1], "rule", 5)


@query("union_distinct_tags", "SELECT tag FROM made UNION SELECT tag FROM need")
def _(t):
    a, b = t.rule_tags
    return a.select("tag").union(b.select("tag")).distinct()


@query("diff_tags", "SELECT tag FROM made EXCEPT SELECT tag FROM need")
def _(t):
    a, b = t.rule_tags
    return a.select("tag").subtract(b.select("tag"))


@query("class_hits_union", "SELECT id, CASE WHEN list_contains(tags, 'building') THEN 'building' WHEN list_contains(tags, 'rich') THEN 'rich' ELSE 'large' END AS tag FROM nodes WHERE list_has_any(tags, ['building', 'rich', 'large'])")
def _(t):
    return tg.hits_union(t.nodes, ["building", "rich", "large"])
