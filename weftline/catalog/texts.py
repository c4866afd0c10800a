"""Line, pattern and scalar queries over documents, pages and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import scores as sc
from weftline.functions import text as tx
from weftline.operators import coupling as cp
from weftline.operators import query as q

_LINES = "list_filter(string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n\\z', ''), chr(10)), lambda x: text <> '')"


@query("file_metrics", f"SELECT doc_id, strlen(text)::BIGINT AS bytes, len({_LINES}) AS lines, len(list_filter({_LINES}, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12)) = '')) AS blank_lines, len(list_filter({_LINES}, lambda x: regexp_matches(x, '^[ \\t\\v\\f]*(//|/\\*|\\*)'))) AS comment_lines FROM documents")
def _(t):
    x = F.col("text")
    return t["documents"].select("doc_id", tx.byte_count(x).alias("bytes"), tx.line_count(x).alias("lines"), tx.blank_count(x).alias("blank_lines"), tx.comment_count(x).alias("comment_lines"))


@query("cloc", f"SELECT lang, sum(len({_LINES}))::BIGINT AS lines FROM documents GROUP BY 1")
def _(t):
    return t["documents"].groupBy("lang").agg(F.sum(tx.line_count(F.col("text"))).alias("lines"))


@query("regex_count", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z]\\w+tion')) AS n FROM documents")
def _(t):
    return t["documents"].select("doc_id", tx.matches(F.col("text"), r"[A-Z]\w+tion").alias("n"))


@query("regex_flag", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under')")
def _(t):
    return t["documents"].filter(tx.has_match(F.col("text"), "(?i)licensed under")).select("doc_id")


_SOURCE = "'package com.' || lang || '.' || source || ';' || chr(10) || 'import java.util.List;' || chr(10) || 'import com.' || lang || '.' || source || '.A' || (doc_id % 7) || ';' || chr(10) || 'import static java.lang.reflect.Method.*;' || chr(10) || 'import java.lang.reflect.Method;' || chr(10) || 'import java.lang.String;' || chr(10) || 'public class C' || doc_id || ' { if (a && b) { } else if (c) ? 1 : 2; }'"


def _sources(t):
    """A Java text for every document, from its own columns."""
    lit, nl = F.lit, F.lit("\n")
    d = F.col("doc_id")
    text = F.concat(lit("package com."), "lang", lit("."), "source", lit(";"), nl, lit("import java.util.List;"), nl, lit("import com."), "lang", lit("."), "source", lit(".A"), (d % 7).cast("string"), lit(";"), nl, lit("import static java.lang.reflect.Method.*;"), nl, lit("import java.lang.reflect.Method;"), nl, lit("import java.lang.String;"), nl, lit("public class C"), d.cast("string"), lit(" { if (a && b) { } else if (c) ? 1 : 2; }"))
    return t["documents"].select("doc_id", F.concat(F.lit("C"), d.cast("string")).alias("name"), text.alias("text"))


@query("import_edges", f"WITH s AS (SELECT 'C' || doc_id AS source_id, unnest(list_distinct(regexp_extract_all({_SOURCE}, '(?m)^\\s*import\\s+(?:static\\s+)?([A-Za-z_][\\w.]*(?:\\.\\*)?)\\s*;', 1))) AS target_id FROM documents) SELECT source_id, target_id, 'imports' AS edge_type FROM s WHERE target_id NOT LIKE '%*' AND (NOT starts_with(target_id, 'java.lang.') OR contains(target_id, '.lang.reflect.'))")
def _(t):
    return cp.import_edges(_sources(t))


@query("import_extract", f"SELECT doc_id, array_to_string(regexp_extract_all({_SOURCE}, '(?m)^\\s*import\\s+(?:static\\s+)?([A-Za-z_][\\w.]*(?:\\.\\*)?)\\s*;', 1), ',') AS imports FROM documents")
def _(t):
    return _sources(t).select("doc_id", F.array_join(tx.imports(F.col("text")), ",").alias("imports"))


@query("package_extract", "SELECT doc_id, 'com.' || lang || '.' || source AS package FROM documents")
def _(t):
    return _sources(t).select("doc_id", tx.package_name(F.col("text")).alias("package"))


@query("src_collect_src", "SELECT 'com.' || lang || '.' || source || '.C' || doc_id AS id, 'C' || doc_id AS simple_name FROM documents")
def _(t):
    s = _sources(t).select(tx.package_name(F.col("text")).alias("p"), F.explode(tx.declared_types(F.col("text"))).alias("simple_name"))
    return s.select(F.concat_ws(".", "p", "simple_name").alias("id"), "simple_name")


@query("cyclomatic", "SELECT doc_id, 1 + 4::BIGINT AS complexity FROM documents")
def _(t):
    return _sources(t).select("doc_id", tx.cyclomatic(F.col("text"), F.lit(1)).alias("complexity"))


@query("page_links", "SELECT page_id AS source_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target_id FROM pages")
def _(t):
    return t["pages"].select(F.col("page_id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("target_id"))


# --- detection by name -------------------------------------------------------------------


@query("src_ignore", "SELECT doc_id FROM files WHERE NOT (path LIKE '%.class' OR starts_with(path, 'target/') OR starts_with(path, 'build/') OR path LIKE '%/.cache/%')")
def _(t):
    return t.files.filter(~q.ignored(F.col("path"), ["*.class", "target/", "/build/**"])).select("doc_id")


@query("src_archive_test", "SELECT doc_id FROM files WHERE regexp_matches(lower(path), '\\.(jar|war|ear|zip)$')")
def _(t):
    return t.files.filter(q.is_archive(F.col("path"))).select("doc_id")


@query("src_archive", "SELECT doc_id, md5(text) AS md5 FROM documents d WHERE doc_id % 3 <> 1 OR length(text) % 2 = 1")
def _(t):
    """Incremental extraction: a third of the old digests are there, half of those with another text."""
    from weftline.operators.merge import changed

    d = t["documents"].select("doc_id", "text")
    old = d.filter("doc_id % 3 = 1").select("doc_id", F.md5(F.when(F.length("text") % 2 == 1, F.concat("text", F.lit("old"))).otherwise(F.col("text"))).alias("md5"))
    return changed(old, d, "doc_id", "text").select("doc_id", "md5")


@query("ext_detect", "SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'java' THEN 'java_source' WHEN 'class' THEN 'java_binary' WHEN 'xml' THEN 'xml_config' WHEN 'properties' THEN 'properties_config' WHEN 'sql' THEN 'sql_script' WHEN 'html' THEN 'html_page' END AS tag FROM files")
def _(t):
    return t.files.select("doc_id", q.extension_tag(F.col("path")).alias("tag"))


@query("name_detect", "SELECT doc_id FROM files WHERE regexp_extract(path, '[^/]+$') IN ('File3.properties', 'File12.properties', 'File2.xml')")
def _(t):
    return t.files.filter(F.substring_index("path", "/", -1).isin("File3.properties", "File12.properties", "File2.xml")).select("doc_id")


@query("source_detect", "SELECT source, count(*) AS files FROM files WHERE regexp_matches(path, '\\.(java|sql)$') GROUP BY 1")
def _(t):
    return t.files.filter(q.extension(F.col("path")).isin("java", "sql")).groupBy("source").agg(F.count("*").alias("files"))


@query("bin_detect", "SELECT doc_id FROM files WHERE path LIKE '%.class'")
def _(t):
    return t.files.filter(q.extension(F.col("path")) == "class").select("doc_id")


@query("java_detect", "SELECT doc_id FROM files WHERE path LIKE '%.java'")
def _(t):
    return t.files.filter(q.extension(F.col("path")) == "java").select("doc_id")


# --- scores and scalars ------------------------------------------------------------------


@query("iface_score", "SELECT p_partkey, floor((p_size * 1.0::DOUBLE + (p_partkey % 9) * 0.5::DOUBLE + (p_partkey % 4) * 1.5::DOUBLE) * CASE WHEN p_size + p_partkey % 9 > 10 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM part")
def _(t):
    k = F.col("p_partkey")
    return t["part"].select("p_partkey", sc.interface_score(F.col("p_size"), k % 9, k % 4).alias("score"))


_TYPES = "CASE WHEN p_size % 10 = 0 THEN 0.0::DOUBLE ELSE floor(((p_partkey % 5) * 1.0::DOUBLE + (p_partkey % 7) * 2.0::DOUBLE + (p_partkey % 3) * 3.0::DOUBLE + 2 * 2.5::DOUBLE + (p_partkey % 2) * 4.0::DOUBLE + 3 * 1.5::DOUBLE) / sqrt((p_size % 10)::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END"


@query("type_score", f"SELECT p_partkey, {_TYPES} AS score, CASE WHEN {_TYPES} > 10 THEN 'HIGH' WHEN {_TYPES} > 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM part")
def _(t):
    k = F.col("p_partkey")
    s = t["part"].withColumn("score", sc.type_score(k % 5, k % 7, k % 3, F.lit(2), k % 2, F.lit(3), F.col("p_size") % 10))
    return s.select("p_partkey", "score", sc.type_level(F.col("score")).alias("level"))


@query("stateful_score", "SELECT p_partkey, p_size % 8 * 2 + p_partkey % 6 * 3 AS score, CASE WHEN p_size % 8 * 2 + p_partkey % 6 * 3 <= 8 THEN 'LOW' WHEN p_size % 8 * 2 + p_partkey % 6 * 3 <= 16 THEN 'MEDIUM' WHEN p_size % 8 * 2 + p_partkey % 6 * 3 <= 24 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM part")
def _(t):
    s = sc.state_score(F.col("p_size") % 8, F.col("p_partkey") % 6)
    return t["part"].select("p_partkey", s.alias("score"), sc.state_level(s).alias("level"))


@query("type_kind", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey & 8192 <> 0 THEN 'annotation' WHEN l_partkey & 512 <> 0 THEN 'interface' WHEN l_partkey & 16384 <> 0 THEN 'enum' WHEN l_linenumber = 3 THEN 'record' ELSE 'class' END AS kind FROM lineitem")
def _(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", tx.type_kind(F.col("l_partkey"), F.col("l_linenumber") == 3).alias("kind"))


@query("java_version", "SELECT p_partkey, CASE WHEN p_size + 40 < 45 THEN NULL WHEN p_size + 40 < 49 THEN '1.' || (p_size - 4) ELSE (p_size - 4)::VARCHAR END AS version FROM part")
def _(t):
    return t["part"].select("p_partkey", tx.java_version(F.col("p_size") + 40).alias("version"))


@query("class_metrics", "SELECT l_suppkey AS class, count(DISTINCT l_partkey) AS fields, count(*) AS methods, count(*) + count(*) FILTER (l_returnflag <> 'N') AS weighted_methods, count(DISTINCT CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01' THEN l_partkey END) AS couplings FROM lineitem GROUP BY 1")
def _(t):
    n = F.count("*")
    return t["lineitem"].groupBy(F.col("l_suppkey").alias("class")).agg(F.countDistinct("l_partkey").alias("fields"), n.alias("methods"), (n + F.count_if(F.col("l_returnflag") != "N")).alias("weighted_methods"), F.countDistinct(F.when(F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp"), F.col("l_partkey"))).alias("couplings"))


@query("method_count", "SELECT l_suppkey AS class, count(*) AS methods, count(*) FILTER (l_linestatus = 'O') AS annotations FROM lineitem GROUP BY 1")
def _(t):
    return t["lineitem"].groupBy(F.col("l_suppkey").alias("class")).agg(F.count("*").alias("methods"), F.count_if(F.col("l_linestatus") == "O").alias("annotations"))


@query("type_usage", "SELECT l_suppkey AS class, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS field_types, count(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS parameter_types, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS return_types, count(DISTINCT l_partkey) AS unique_types FROM lineitem GROUP BY 1")
def _(t):
    role = lambda r: F.countDistinct(F.when(F.col("l_returnflag") == r, F.col("l_partkey")))
    return t["lineitem"].groupBy(F.col("l_suppkey").alias("class")).agg(role("A").alias("field_types"), role("N").alias("parameter_types"), role("R").alias("return_types"), F.countDistinct("l_partkey").alias("unique_types"))


@query("threadlocal", "SELECT l_suppkey AS class, count(*) AS n, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS fields FROM lineitem WHERE l_discount = 0.1 GROUP BY 1")
def _(t):
    l = t["lineitem"].filter("l_discount = 0.1")
    return l.groupBy(F.col("l_suppkey").alias("class")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ",").alias("fields"))


@query("quality_reply", "WITH r AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE 'score: ' || (p_size * 3)::VARCHAR || '.' || (p_partkey % 10) END AS reply, (p_size * 3 || '.' || (p_partkey % 10))::DOUBLE AS n FROM part), s AS (SELECT p_partkey, CASE WHEN reply = 'none' THEN NULL WHEN n > 10 AND n <= 100 THEN n / 10 ELSE n END AS n FROM r) SELECT p_partkey, CASE WHEN n IS NULL THEN 5.0::DOUBLE ELSE floor(greatest(1.0::DOUBLE, least(10.0::DOUBLE, n)) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE END AS quality FROM s")
def _(t):
    reply = F.when(F.col("p_size") % 4 == 0, "none").otherwise(F.concat(F.lit("score: "), (F.col("p_size") * 3).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string")))
    return t["part"].select("p_partkey", sc.quality_score(reply).alias("quality"))


@query(
    "scalar_functions",
    """SELECT p_partkey, starts_with(p_type, 'PROMO') AS a, string_split(p_name, ' ')[-1] AS b, replace(lower(trim(p_brand)), '#', '_') AS c, levenshtein(p_brand, 'Brand#11')::INT AS d,
floor(p_retailprice * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS e, CASE WHEN p_size % 5 = 0 THEN 0.0::DOUBLE ELSE p_size / (p_size % 5)::DOUBLE END AS f, md5(p_name) AS g, (p_partkey & 12) <> 0 AS h,
CASE WHEN contains(p_name, '"') OR contains(p_name, ',') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END AS i FROM part""",
)
def _(t):
    name = F.col("p_name")
    csv = F.when(name.contains('"') | name.contains(","), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)
    return t["part"].select(
        "p_partkey",
        F.col("p_type").startswith("PROMO").alias("a"),
        F.substring_index("p_name", " ", -1).alias("b"),
        F.replace(F.lower(F.trim("p_brand")), F.lit("#"), F.lit("_")).alias("c"),
        F.levenshtein("p_brand", F.lit("Brand#11")).alias("d"),
        sc.round_half_up(F.col("p_retailprice"), 1).alias("e"),
        sc.ratio(F.col("p_size"), F.col("p_size") % 5).alias("f"),
        F.md5("p_name").alias("g"),
        (F.col("p_partkey").bitwiseAND(12) != 0).alias("h"),
        csv.alias("i"),
    )
