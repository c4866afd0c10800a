"""A property graph and a call log over the TPC-like tables, in Spark and as SQL views.

Nodes are regions, nations, customers, suppliers, parts and documents; suppliers also
play the part of classes, their nation that of the package. All rows of all tables take
part.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.graph import Graph

EPOCH = "2024-01-01 00:00:00"


def _born(key: Column) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + key.cast("long") * 60)


def _tags(*pairs: tuple[str, Column]) -> Column:
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in pairs)))) if pairs else F.expr("array()").cast("array<string>")


def _strings(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))


def _doubles(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double")))) if values else F.expr("map()").cast("map<string,double>")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _node(self, table: str, prefix: str, key: str, label: str, properties: Column, metrics: Column, tags: Column) -> DataFrame:
        k = F.col(key)
        return self[table].select(F.concat(F.lit(prefix + ":"), k.cast("string")).alias("id"), F.lit(table).alias("node_type"), F.col(label).alias("display_label"), properties.alias("properties"), metrics.alias("metrics"), tags.alias("tags"), _born(k).alias("created_at"), _born(k * 2).alias("updated_at"))

    @cached_property
    def nodes(self) -> DataFrame:
        bal, price, size = F.col("c_acctbal"), F.col("p_retailprice"), F.col("p_size")
        parts = [
            self._node("region", "r", "r_regionkey", "r_name", _strings(name=F.col("r_name")), _doubles(), _tags()),
            self._node("nation", "n", "n_nationkey", "n_name", _strings(name=F.col("n_name"), region=F.col("n_regionkey")), _doubles(), _tags()),
            self._node("customer", "c", "c_custkey", "c_name", _strings(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")), _doubles(acctbal=bal), _tags(("negative", bal < 0), ("rich", bal > 5000), ("building", F.col("c_mktsegment") == "BUILDING"))),
            self._node("supplier", "s", "s_suppkey", "s_name", _strings(nation=F.col("s_nationkey")), _doubles(acctbal=F.col("s_acctbal")), _tags(("negative", F.col("s_acctbal") < 0), ("rich", F.col("s_acctbal") > 5000))),
            self._node("part", "p", "p_partkey", "p_name", _strings(brand=F.col("p_brand"), type=F.col("p_type")), _doubles(retailprice=price, size=size), _tags(("large", size > 40), ("cheap", price < 1000), ("rich", price > 1500))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def edges(self) -> DataFrame:
        def edge(df: DataFrame, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
            return df.select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(b + ":"), F.col(y).cast("string")).alias("target_id"), F.lit(kind).alias("edge_type"), F.expr("map()").cast("map<string,string>").alias("properties"), _born(F.col(x)).alias("created_at"))

        supplies = self["lineitem"].select("l_suppkey", "l_partkey").distinct()
        return (
            edge(self["nation"], "n", "n_nationkey", "r", "n_regionkey", "contains")
            .unionByName(edge(self["customer"], "c", "c_custkey", "n", "c_nationkey", "contains"))
            .unionByName(edge(self["supplier"], "s", "s_suppkey", "n", "s_nationkey", "contains"))
            .unionByName(edge(supplies, "s", "l_suppkey", "p", "l_partkey", "uses"))
        )

    @cached_property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    @cached_property
    def classes(self) -> DataFrame:
        """Suppliers as classes: id, package, kind, is_abstract."""
        k = F.col("s_suppkey")
        kind = F.when(k % 7 == 0, "interface").when(k % 11 == 0, "enum").otherwise("class")
        package = F.concat(F.lit("com."), F.lower(F.col("r_name")), F.lit("."), F.lower(F.col("n_name")))
        s = self["supplier"].join(self["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(self["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.concat(F.lit("s:"), k.cast("string")).alias("id"), package.alias("package"), kind.alias("kind"), (k % 5 == 0).alias("is_abstract"), k.alias("key"))

    @cached_property
    def class_edges(self) -> DataFrame:
        """extends: the tree key -> key / 2; implements: the nation's smallest supplier; uses: the supplier that most often has the next line of an order."""
        sid = lambda c: F.concat(F.lit("s:"), c.cast("string"))
        s = self["supplier"]
        tree = s.filter("s_suppkey > 0").select(sid(F.col("s_suppkey")).alias("source_id"), sid(F.floor(F.col("s_suppkey") / 2)).alias("target_id"), F.lit("extends").alias("edge_type"))
        hubs = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("hub"))
        star = s.join(hubs, "s_nationkey").filter("s_suppkey != hub").select(sid(F.col("s_suppkey")).alias("source_id"), sid(F.col("hub")).alias("target_id"), F.lit("implements").alias("edge_type"))
        lines = self["lineitem"].select("l_orderkey", "l_linenumber", "l_suppkey")
        after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("next"))
        pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("l_suppkey != next").groupBy("l_suppkey", "next").agg(F.count("*").alias("n"))
        best = pairs.groupBy("l_suppkey").agg(F.min_by("next", F.struct((-F.col("n")).alias("n"), "next")).alias("next"))
        return tree.unionByName(star).unionByName(best.select(sid(F.col("l_suppkey")).alias("source_id"), sid(F.col("next")).alias("target_id"), F.lit("uses").alias("edge_type")))

    @cached_property
    def calls(self) -> DataFrame:
        """events as a call log: five types are patterns, an error is a failure."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self["events"].select(F.col("event_id").cast("string").alias("call_id"), "ts", F.col("event_type").alias("pattern"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 3 == 0).alias("script_generated"), (F.col("event_id") % 4 == 0).alias("cache_hit"), k.alias("matches"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 5 != 0, k * 10).alias("tokens"), F.when(F.col("event_id") % 5 != 0, k * 0.25).alias("cost"))

    @cached_property
    def runs(self) -> DataFrame:
        """events as a run log of rules over files: rule, file, phase, seq, ms."""
        return self["events"].select(F.col("event_type").alias("rule"), F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("file"), F.concat(F.lit("phase"), (F.col("event_id") % 3).cast("string")).alias("phase"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))

    @cached_property
    def plan_runs(self) -> DataFrame:
        """orders as block runs of plans."""
        status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "IN_PROGRESS").otherwise("FAILED")
        return self["orders"].select(F.concat(F.lit("plan"), (F.col("o_custkey") % 20).cast("string")).alias("plan"), F.col("o_orderpriority").alias("phase"), F.concat(F.lit("t"), (F.col("o_custkey") % 100).cast("string")).alias("task"), F.col("o_orderkey").cast("string").alias("block"), status.alias("status"), F.col("o_orderdate").alias("completed_at"))

    @cached_property
    def rule_tags(self) -> tuple[DataFrame, DataFrame]:
        """(rule, tag) produced by suppliers (types of parts they supply) and needed by customers' segments' orders (types they buy)."""
        l, p, s = self["lineitem"], self["part"].select("p_partkey", "p_type", "p_size"), self["supplier"]
        made = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        made = made.filter("p_size > 25").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("rule"), F.concat(F.lit("tag_"), F.col("p_size").cast("string")).alias("tag")).distinct()
        o, c = self["orders"], self["customer"]
        need = l.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        need = need.filter("p_size between 10 and 45").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("rule"), F.concat(F.lit("tag_"), F.col("p_size").cast("string")).alias("tag")).distinct()
        return made, need

    @cached_property
    def versions(self) -> DataFrame:
        """orders as repeated observations of customers: id, label, value, flag, level, seen_at, seq."""
        level = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "ODD"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
        return self["orders"].select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") - 1000).alias("value"), (F.col("o_orderstatus") == "F").alias("flag"), F.when(F.col("o_orderkey") % 9 != 0, level).alias("level"), F.col("o_orderdate").alias("seen_at"), F.col("o_orderkey").alias("seq"))

    @cached_property
    def units(self) -> DataFrame:
        """Parts as parsed classes."""
        return self["part"].selectExpr(
            "concat('p', p_partkey) AS id",
            "element_at(array('OrderCache', 'UserFactory', 'AppConfig', 'SecurityGate', 'AuditInterceptor', 'PlainThing', 'ItemRegistry', 'DateUtils'), p_size % 8 + 1) AS name",
            "element_at(array('STATELESS', 'STATEFUL', 'ENTITY', 'MESSAGE_DRIVEN', 'SINGLETON', NULL), cast(p_partkey % 6 + 1 AS int)) AS kind",
            "p_partkey % 9 = 0 AS is_interface",
            "CASE p_partkey % 7 WHEN 0 THEN array('RolesAllowed') WHEN 1 THEN array('Stateless') WHEN 2 THEN array('Entity', 'Interceptor') WHEN 3 THEN array('MessageDriven') WHEN 4 THEN array('Stateful') ELSE cast(array() AS array<string>) END AS annotations",
            "CASE p_size % 7 WHEN 0 THEN array('SessionBean') WHEN 1 THEN array('EntityBean') WHEN 2 THEN array('MessageDrivenBean') WHEN 3 THEN array('EJBHome') WHEN 4 THEN array('javax.ejb.EJBObject') WHEN 5 THEN array('HttpServlet') ELSE array('EJBLocalHome') END AS supertypes",
            "CASE p_partkey % 5 WHEN 0 THEN array('java.util.List', 'javax.naming.InitialContext') WHEN 1 THEN array('java.util.concurrent.Future') WHEN 2 THEN array('javax.interceptor.InvocationContext') ELSE cast(array() AS array<string>) END AS imports",
            "p_partkey % 4 = 0 AS private_constructor",
        )

    @cached_property
    def fields(self) -> DataFrame:
        """Lines as fields of the classes."""
        return self["lineitem"].selectExpr(
            "concat('p', l_partkey) AS id",
            "element_at(array('itemCache', 'log', 'count', 'MAX_SIZE', 'dataSource', 'SERVER_URL', 'state'), cast((l_orderkey + l_linenumber) % 7 + 1 AS int)) AS name",
            "element_at(array('HashMap', 'Logger', 'int', 'ArrayList', 'DataSource', 'EntityManager', 'Event', 'LruCache', 'ItemRegistry'), cast(l_suppkey % 9 + 1 AS int)) AS type",
            "l_quantity < 20 AS is_static",
            "l_discount > 0.05 AS is_final",
            "CASE l_linenumber % 5 WHEN 0 THEN array('Inject') WHEN 1 THEN array('Resource') WHEN 2 THEN array('EJB', 'Resource') ELSE cast(array() AS array<string>) END AS annotations",
        )

    @cached_property
    def methods(self) -> DataFrame:
        """Lines as methods of the classes."""
        return self["lineitem"].selectExpr(
            "concat('p', l_partkey) AS id",
            "element_at(array('createOrder', 'getInstance', 'lookupHome', 'openConnection', 'saveAll', 'ejbCreate', 'BuildView', 'closeResultSet', 'run', 'loginUser', 'aroundCall'), cast(l_orderkey % 11 + 1 AS int)) AS name",
            "element_at(array('void', 'String', 'OrderCache'), l_linenumber % 3 + 1) AS return_type",
            "l_tax > 0.04 AS is_static",
            "l_returnflag <> 'R' AS is_public",
            "l_quantity > 40 AS is_synchronized",
            "CASE l_suppkey % 8 WHEN 0 THEN array('PostConstruct') WHEN 1 THEN array('DenyAll') WHEN 2 THEN array('Override') WHEN 3 THEN array('javax.ejb.AroundInvoke') ELSE cast(array() AS array<string>) END AS annotations",
        )

    @cached_property
    def names(self) -> DataFrame:
        """Names for similarity: customer segments with statuses, part brands and types."""
        a = self["part"].select(F.concat_ws("_", F.upper(F.regexp_replace("p_type", " ", "_")), F.when(F.col("p_partkey") % 2 == 0, "FOUND").otherwise("DETECTED")).alias("name"))
        return a.union(self["part"].select(F.concat(F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("_config")).alias("name"))).distinct()

    @cached_property
    def files(self) -> DataFrame:
        """Paths of documents and pages, with suffixes of all kinds."""
        ends = F.element_at(F.array(*map(F.lit, ("java", "class", "xml", "properties", "sql", "html", "JAR", "txt", "war"))), (F.col("doc_id") % 9 + 1).cast("int"))
        folder = F.element_at(F.array(*map(F.lit, ("src/main", "target", "src/test/.cache", "lib", "build/out"))), (F.col("doc_id") % 5 + 1).cast("int"))
        return self["documents"].select("doc_id", F.concat(folder, F.lit("/"), "lang", F.lit("/File"), F.col("doc_id").cast("string"), F.lit("."), ends).alias("path"), "text", "source")


_R = "'r:' || r_regionkey"
# The same frames as SQL views; an oracle carries those that it uses.
PRELUDE = {
    "nodes": f"""
SELECT {_R} AS id, 'region' AS node_type, r_name AS display_label, MAP {{'name': r_name}} AS properties, MAP([]::VARCHAR[], []::DOUBLE[]) AS metrics, []::VARCHAR[] AS tags, r_regionkey::BIGINT AS k FROM region
UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, MAP {{'name': n_name, 'region': n_regionkey::VARCHAR}}, MAP([]::VARCHAR[], []::DOUBLE[]), []::VARCHAR[], n_nationkey FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name, MAP {{'segment': c_mktsegment, 'nation': c_nationkey::VARCHAR}}, MAP {{'acctbal': c_acctbal}},
  list_sort(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END], lambda x: x IS NOT NULL)), c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, MAP {{'nation': s_nationkey::VARCHAR}}, MAP {{'acctbal': s_acctbal}},
  list_sort(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_acctbal > 5000 THEN 'rich' END], lambda x: x IS NOT NULL)), s_suppkey FROM supplier
UNION ALL SELECT 'p:' || p_partkey, 'part', p_name, MAP {{'brand': p_brand, 'type': p_type}}, MAP {{'retailprice': p_retailprice, 'size': p_size::DOUBLE}},
  list_sort(list_filter([CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice < 1000 THEN 'cheap' END, CASE WHEN p_retailprice > 1500 THEN 'rich' END], lambda x: x IS NOT NULL)), p_partkey FROM part""",
    "born": "SELECT *, TIMESTAMP '2024-01-01' + to_minutes(k) AS created_at, TIMESTAMP '2024-01-01' + to_minutes(2 * k) AS updated_at FROM nodes",
    "edges": """
SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'contains' AS edge_type, n_nationkey::BIGINT AS k FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'contains', c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'contains', s_suppkey FROM supplier
UNION ALL SELECT 's:' || l_suppkey, 'p:' || l_partkey, 'uses', l_suppkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)""",
    "classes": """
SELECT 's:' || s_suppkey AS id, 'com.' || lower(r_name) || '.' || lower(n_name) AS package,
  CASE WHEN s_suppkey % 7 = 0 THEN 'interface' WHEN s_suppkey % 11 = 0 THEN 'enum' ELSE 'class' END AS kind, s_suppkey % 5 = 0 AS is_abstract, s_suppkey AS key
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "class_edges": """
SELECT 's:' || s_suppkey AS source_id, 's:' || (s_suppkey // 2) AS target_id, 'extends' AS edge_type FROM supplier WHERE s_suppkey > 0
UNION ALL SELECT 's:' || s_suppkey, 's:' || hub, 'implements' FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS hub FROM supplier) WHERE s_suppkey <> hub
UNION ALL SELECT 's:' || l_suppkey, 's:' || nxt, 'uses' FROM (
  SELECT l_suppkey, nxt, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, nxt) AS r FROM (
    SELECT a.l_suppkey, b.l_suppkey AS nxt, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)) WHERE r = 1""",
    "reach": "SELECT DISTINCT source_id AS s, target_id AS t FROM class_edges WHERE source_id <> target_id UNION SELECT r.s, e.target_id FROM reach r JOIN class_edges e ON e.source_id = r.t",
    "calls": """
SELECT event_id::VARCHAR AS call_id, ts, event_type AS pattern, event_type <> 'error' AS success, event_id % 3 = 0 AS script_generated, event_id % 4 = 0 AS cache_hit,
  json_extract_string(props, '$.k')::BIGINT AS matches, value AS duration_ms,
  CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k')::BIGINT * 10 END AS tokens, CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k')::BIGINT * 0.25::DOUBLE END AS cost FROM events""",
    "runs": "SELECT event_type AS rule, 'f' || (user_id % 50) AS file, 'phase' || (event_id % 3) AS phase, event_id AS seq, value AS ms FROM events",
    "plan_runs": """
SELECT 'plan' || (o_custkey % 20) AS plan, o_orderpriority AS phase, 't' || (o_custkey % 100) AS task, o_orderkey::VARCHAR AS block,
  CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'FAILED' END AS status, o_orderdate AS completed_at FROM orders""",
    "made": "SELECT DISTINCT 'n' || s_nationkey AS rule, 'tag_' || p_size AS tag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25",
    "need": "SELECT DISTINCT 'n' || c_nationkey AS rule, 'tag_' || p_size AS tag FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE p_size BETWEEN 10 AND 45",
    "versions": """
SELECT 'c:' || o_custkey AS id, o_orderpriority AS label, o_totalprice - 1000 AS value, o_orderstatus = 'F' AS flag,
  CASE WHEN o_orderkey % 9 <> 0 THEN (['LOW', 'MEDIUM', 'HIGH', 'ODD'])[o_orderkey % 4 + 1] END AS level, o_orderdate AS seen_at, o_orderkey AS seq FROM orders""",
    "units": """
SELECT 'p' || p_partkey AS id, p_size, p_partkey, (['OrderCache', 'UserFactory', 'AppConfig', 'SecurityGate', 'AuditInterceptor', 'PlainThing', 'ItemRegistry', 'DateUtils'])[p_size % 8 + 1] AS name,
  (['STATELESS', 'STATEFUL', 'ENTITY', 'MESSAGE_DRIVEN', 'SINGLETON', NULL])[p_partkey % 6 + 1] AS kind, p_partkey % 9 = 0 AS is_interface, p_partkey % 4 = 0 AS private_constructor FROM part""",
    "fields": """
SELECT 'p' || l_partkey AS id, (['itemCache', 'log', 'count', 'MAX_SIZE', 'dataSource', 'SERVER_URL', 'state'])[(l_orderkey + l_linenumber) % 7 + 1] AS name,
  (['HashMap', 'Logger', 'int', 'ArrayList', 'DataSource', 'EntityManager', 'Event', 'LruCache', 'ItemRegistry'])[l_suppkey % 9 + 1] AS type, l_quantity < 20 AS is_static, l_discount > 0.05 AS is_final,
  l_linenumber % 5 = 0 AS inject, l_linenumber % 5 IN (1, 2) AS resource, l_linenumber % 5 = 2 AS ejb FROM lineitem""",
    "methods": """
SELECT 'p' || l_partkey AS id, (['createOrder', 'getInstance', 'lookupHome', 'openConnection', 'saveAll', 'ejbCreate', 'BuildView', 'closeResultSet', 'run', 'loginUser', 'aroundCall'])[l_orderkey % 11 + 1] AS name,
  (['void', 'String', 'OrderCache'])[l_linenumber % 3 + 1] AS return_type, l_tax > 0.04 AS is_static, l_returnflag <> 'R' AS is_public, l_suppkey % 8 AS mark FROM lineitem""",
    "names": """
SELECT DISTINCT * FROM (SELECT upper(replace(p_type, ' ', '_')) || '_' || CASE WHEN p_partkey % 2 = 0 THEN 'FOUND' ELSE 'DETECTED' END AS name FROM part
UNION ALL SELECT lower(replace(p_brand, '#', '_')) || '_config' FROM part)""",
    "files": """
SELECT doc_id, (['src/main', 'target', 'src/test/.cache', 'lib', 'build/out'])[doc_id % 5 + 1] || '/' || lang || '/File' || doc_id || '.' ||
  (['java', 'class', 'xml', 'properties', 'sql', 'html', 'JAR', 'txt', 'war'])[doc_id % 9 + 1] AS path, text, source FROM documents""",
}


def oracle(sql: str) -> str:
    """The query with the views that it uses, and those that these use."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in PRELUDE.items():
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                if name != "reach" or text is not body:
                    wanted.append(name)
                    visit(body)

    visit(sql)
    views = ", ".join(f"{n} AS ({PRELUDE[n]})" for n in PRELUDE if n in wanted)
    sql = sql.strip()
    if not views:
        return sql
    more = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH RECURSIVE {views}" + (f", {sql[more.end():]}" if more else f" {sql}")
