"""Rules over class structure, settings files and deployment descriptors, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import tags as tg
from weftline.plans import structure as st


@query(
    "anti_patterns",
    """SELECT f.id, 'MUTABLE_STATE_IN_STATELESS_BEAN' AS type, 'HIGH' AS severity, 'field:' || f.name AS location, 'Convert to constructor injection or make final' AS advice FROM fields f JOIN units u USING (id) WHERE kind = 'STATELESS' AND NOT is_final AND NOT is_static AND type NOT IN ('Logger', 'EntityManager') AND NOT (inject AND type = 'Event')
UNION ALL SELECT id, 'NON_THREAD_SAFE_COLLECTION', 'HIGH', 'field:' || name, 'Use ConcurrentHashMap or make thread-safe' FROM fields WHERE type IN ('HashMap', 'ArrayList') AND NOT is_final AND NOT inject
UNION ALL SELECT id, 'CACHING_IN_STATELESS_BEAN', 'HIGH', 'field:' || name, 'Use Spring Cache abstraction with proper scope' FROM fields WHERE type = 'LruCache' OR name = 'itemCache'
UNION ALL SELECT id, 'UNINJECTED_RESOURCE', 'MEDIUM', 'field:' || name, 'Use @Autowired to inject DataSource' FROM fields WHERE type = 'DataSource' AND NOT inject AND NOT resource
UNION ALL SELECT id, 'FACTORY_METHOD', 'MEDIUM', 'method:' || name, 'Move to @Configuration class with @Bean methods' FROM methods WHERE name IN ('createOrder', 'getInstance', 'BuildView') AND is_static AND return_type <> 'void'
UNION ALL SELECT id, 'MANUAL_RESOURCE_MANAGEMENT', 'MEDIUM', 'method:' || name, 'Use Spring''s JdbcTemplate or proper resource management' FROM methods WHERE name IN ('openConnection', 'closeResultSet')
UNION ALL SELECT id, 'JNDI_LOOKUP', 'HIGH', 'method:lookupHome', 'Replace with Spring dependency injection' FROM methods WHERE name = 'lookupHome'
UNION ALL SELECT id, 'JNDI_LOOKUP', 'HIGH', 'class', 'Replace with Spring dependency injection' FROM units WHERE p_partkey % 5 = 0
UNION ALL SELECT id, 'THREAD_MANAGEMENT', 'HIGH', 'class', 'Use Spring''s @Async or proper thread pool management' FROM units WHERE p_partkey % 5 = 1""",
)
def _(t):
    return st.anti_patterns(t.units, t.fields, t.methods)


@query(
    "migration_complexity",
    """WITH f AS (SELECT id, sum(ejb::INT + resource::INT) AS d FROM fields GROUP BY 1), m AS (SELECT id, sum((mark = 0)::INT + (name = 'ejbCreate')::INT) AS l, bool_or(mark = 1) AS s FROM methods GROUP BY 1),
x AS (SELECT id, CASE kind WHEN 'STATELESS' THEN 1 WHEN 'STATEFUL' THEN 3 WHEN 'ENTITY' THEN 4 WHEN 'MESSAGE_DRIVEN' THEN 2 WHEN 'SINGLETON' THEN 2 ELSE 0 END + coalesce(d, 0) + coalesce(l, 0) + (coalesce(s, false) OR p_partkey % 7 = 0)::INT AS score FROM units LEFT JOIN f USING (id) LEFT JOIN m USING (id))
SELECT id, score::BIGINT AS score, CASE WHEN score <= 3 THEN 'LOW' WHEN score <= 7 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM x""",
)
def _(t):
    return st.migration_complexity(t.units, t.fields, t.methods)


@query(
    "config_constants",
    """WITH f AS (SELECT id, count(*) AS n, count(*) FILTER (is_static AND is_final) / count(*)::DOUBLE AS constant_share, count(*) FILTER (is_static AND is_final AND name IN ('itemCache', 'MAX_SIZE', 'SERVER_URL')) / count(*)::DOUBLE AS name_share FROM fields GROUP BY 1)
SELECT id, constant_share, name_share FROM f JOIN units USING (id) WHERE (constant_share >= 0.8 AND n >= 3) OR (name = 'AppConfig' AND constant_share >= 0.5) OR (name_share > 0.4 AND constant_share >= 0.7)""",
)
def _(t):
    return st.config_constants(t.units, t.fields)


@query(
    "cache_singletons",
    """WITH f AS (SELECT id, count(*) FILTER (is_static) AS n FROM fields GROUP BY 1), m AS (SELECT id, bool_or(name = 'getInstance' AND is_static) AS g FROM methods GROUP BY 1)
SELECT id, coalesce(n, 0) AS static_fields, CASE WHEN g THEN 'singleton' WHEN n > 1 THEN 'cache' END AS target FROM units LEFT JOIN f USING (id) LEFT JOIN m USING (id) WHERE n > 0 OR g OR (name IN ('OrderCache', 'ItemRegistry') AND private_constructor)""",
)
def _(t):
    return st.cache_singletons(t.units, t.fields, t.methods)


@query("singletons", "SELECT DISTINCT id FROM units u WHERE private_constructor AND (EXISTS (SELECT 1 FROM fields f WHERE f.id = u.id AND is_static AND type = u.name) OR EXISTS (SELECT 1 FROM methods m WHERE m.id = u.id AND m.name = 'getInstance' AND is_static AND is_public AND return_type = u.name))")
def _(t):
    return st.singletons(t.units, t.fields, t.methods)


@query(
    "security_facades",
    """WITH m AS (SELECT id, count(*) FILTER (name = 'loginUser') AS n, count(*) FILTER (mark = 1) AS a FROM methods GROUP BY 1)
SELECT id, coalesce(n, 0) AS security_methods FROM units LEFT JOIN m USING (id) WHERE p_partkey % 50 = 0 OR (name IN ('UserFactory', 'SecurityGate') AND (n > 0 OR a > 0))""",
)
def _(t):
    return st.security_facades(t.units, t.methods, F.substring("id", 2, 20).cast("long") % 50 == 0)


@query(
    "interceptors",
    """WITH m AS (SELECT id, bool_or(mark IN (0, 3)) AS marked, bool_or(mark = 3 OR name = 'aroundCall') AS named FROM methods GROUP BY 1)
SELECT id FROM units LEFT JOIN m USING (id) WHERE marked OR p_partkey % 7 = 2 OR p_partkey % 5 = 2 OR (name IN ('SecurityGate', 'AuditInterceptor') AND named)""",
)
def _(t):
    return st.interceptors(t.units, t.methods)


@query(
    "class_roles",
    """SELECT id, 'session' AS role, CASE WHEN p_partkey % 7 IN (1, 4) THEN '3.x' ELSE '2.x' END AS version FROM units WHERE NOT is_interface AND (p_partkey % 7 IN (1, 4) OR p_size % 7 = 0)
UNION ALL SELECT id, 'entity', CASE WHEN p_partkey % 7 = 2 THEN '3.x' ELSE '2.x' END FROM units WHERE NOT is_interface AND (p_partkey % 7 = 2 OR p_size % 7 = 1)
UNION ALL SELECT id, 'message_driven', CASE WHEN p_partkey % 7 = 3 THEN '3.x' ELSE '2.x' END FROM units WHERE NOT is_interface AND (p_partkey % 7 = 3 OR p_size % 7 = 2)
UNION ALL SELECT id, 'servlet', '2.x' FROM units WHERE NOT is_interface AND p_size % 7 = 5
UNION ALL SELECT id, (['remote_home', 'remote', 'local_home'])[CASE p_size % 7 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END], '2.x' FROM units WHERE is_interface AND p_size % 7 IN (3, 4, 6)""",
)
def _(t):
    return st.roles(t.units)


_SETTINGS = ("<jndi-name>java:/comp/env/ds</jndi-name>", "<DataSource><min-pool-size>5</min-pool-size><max-pool-size>9</max-pool-size></DataSource>", "jboss wildfly driver-class", "", "xa-datasource java:jboss/x")


@query("resource_settings", "SELECT doc_id AS id, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END::INT AS datasource, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 4 THEN 1 ELSE 0 END::INT AS jndi, CASE doc_id % 5 WHEN 1 THEN 4 ELSE 0 END::INT AS pool, CASE doc_id % 5 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 0 END::INT AS vendor FROM documents")
def _(t):
    """Every document with a line of settings behind its whole text."""
    d = t["documents"]
    more = F.element_at(F.array(*map(F.lit, _SETTINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return st.resource_settings(d.select("doc_id", F.concat_ws("\n", "text", more).alias("text")), id_col="doc_id")


_FILES = ("ejb-jar.xml", "struts-config.xml", "hibernate.cfg.xml", "spring.xml", "faces-config.xml", "deploy.wsdd", "log4j.xml", "c3p0.properties", "project.xml", "freemarker.properties", "security.xml", "Main.java", "Spring.xml", "server.xml", "weblogic-web.xml", "ibm-auth-bnd.xml", "sun-jms.conf", "orion-datasource-ds.xml", "jms.xml")


def _setting_files(t):
    return t["documents"].select("doc_id", F.element_at(F.array(*map(F.lit, _FILES)), (F.col("doc_id") % len(_FILES) + 1).cast("int")).alias("name"))


_FRAMEWORKS = "'ejb_deployment_descriptor', 'struts_configuration', 'hibernate_configuration', 'spring_legacy_configuration', 'jsf_configuration', 'axis_webservice', 'log4j_configuration', 'connection_pool_configuration', 'legacy_build_configuration', 'web_framework_configuration', 'security_framework_configuration'"


@query("legacy_files", f"SELECT doc_id AS id, ([{_FRAMEWORKS}])[doc_id % 19 + 1] AS framework FROM documents WHERE doc_id % 19 < 11")
def _(t):
    return st.legacy_files(_setting_files(t), id_col="doc_id")


@query(
    "server_files",
    """SELECT doc_id AS id, CASE doc_id % 19 WHEN 13 THEN 'tomcat' WHEN 14 THEN 'weblogic' WHEN 15 THEN 'websphere' WHEN 16 THEN 'glassfish' WHEN 17 THEN 'oracle' END AS server,
CASE doc_id % 19 WHEN 14 THEN 'web' WHEN 15 THEN 'security' WHEN 16 THEN 'messaging' WHEN 17 THEN 'datasource' WHEN 18 THEN 'messaging' END AS sets FROM documents WHERE doc_id % 19 IN (0, 7, 9, 13, 14, 15, 16, 17, 18)""",
)
def _(t):
    return st.server_files(_setting_files(t), id_col="doc_id")


def _descriptors(t):
    """A descriptor a supplier: a session bean with two interfaces, an entity with local ones, and a message bean."""
    k = F.col("s_suppkey").cast("string")
    bean = lambda kind, no, *inner: F.concat(F.lit(f"<{kind}><ejb-name>B"), k, F.lit(f"_{no}</ejb-name><ejb-class>a.Bean"), k, F.lit(f"_{no}</ejb-class>"), *inner, F.lit(f"</{kind}>"))
    end = lambda tag, prefix: F.concat(F.lit(f"<{tag}>{prefix}"), k, F.lit(f"</{tag}>"))
    xml = F.concat(F.lit("<ejb-jar><enterprise-beans>"), bean("session", 1, end("home", "a.Home"), end("remote", "a.Remote")), bean("session", 2, F.lit("<local> </local>")), bean("entity", 3, end("local-home", "a.LocalHome"), end("local", "a.Local")), bean("message-driven", 4), F.lit("</enterprise-beans></ejb-jar>"))
    return t["supplier"].select(F.when(F.col("s_suppkey") % 10 == 9, "no xml").otherwise(xml).alias("text"))


@query("descriptor_beans", "SELECT (['session', 'session', 'entity', 'message-driven'])[i] AS bean_type, 'B' || s_suppkey || '_' || i AS name, 'a.Bean' || s_suppkey || '_' || i AS bean_class, CASE WHEN i = 1 THEN 'a.Home' || s_suppkey END AS home, CASE WHEN i = 1 THEN 'a.Remote' || s_suppkey END AS remote, CASE WHEN i = 3 THEN 'a.LocalHome' || s_suppkey END AS local_home, CASE WHEN i = 3 THEN 'a.Local' || s_suppkey END AS local FROM supplier, (VALUES (1), (2), (3), (4)) AS v(i) WHERE s_suppkey % 10 <> 9")
def _(t):
    beans = st.descriptor_beans(_descriptors(t))
    return beans.withColumn("local", F.nullif(F.trim("local"), F.lit("")))


@query("descriptor_edges", "WITH e AS (SELECT 'a.Bean' || s_suppkey || b AS source_id, p || s_suppkey AS target_id, k AS edge_type FROM supplier, (VALUES ('_1', 'a.Home', 'ejb_home'), ('_1', 'a.Remote', 'ejb_remote'), ('_3', 'a.LocalHome', 'ejb_local_home'), ('_3', 'a.Local', 'ejb_local')) AS v(b, p, k) WHERE s_suppkey % 10 <> 9) SELECT * FROM e UNION ALL SELECT source_id, target_id, 'implements' FROM e")
def _(t):
    return st.descriptor_edges(st.descriptor_beans(_descriptors(t)))


@query("templates", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'Class ' || p_name || ' of ' || p_brand || ' costs ${' END AS text FROM part")
def _(t):
    """`${name}` replaced by the row's values; without one of them there is no text."""
    values = F.map_filter(F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand")), lambda k, v: (k != "brand") | (F.col("p_size") % 3 != 0))
    return t["part"].select("p_partkey", st.substitute(F.lit("Class ${name} of ${ brand } costs ${"), values).alias("text"))


@query("tag_has", "SELECT id, list_contains(tags, 'rich') AS has FROM nodes")
def _(t):
    return t.nodes.select("id", F.coalesce(F.array_contains("tags", "rich"), F.lit(False)).alias("has"))


@query("tag_count", "SELECT id, len(tags)::INT AS tags FROM nodes")
def _(t):
    return t.nodes.select("id", F.coalesce(F.size(F.array_distinct("tags")), F.lit(0)).alias("tags"))


@query("tags_by_node", "SELECT id, unnest(tags) AS tag FROM nodes WHERE node_type = 'customer'")
def _(t):
    return tg.tag_rows(t.nodes.filter("node_type = 'customer'"))
