"""Graphs in Parquet, and their exports.

Nodes are partitioned by node_type and edges by edge_type, so that loads of some types
read only their folders.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.graph import Graph
from weftline.operators.metrics import pivot_columns, pivoted
from weftline.operators.tags import inverted_index


def save_graph(g: Graph, path: str, mode: str = "overwrite") -> None:
    g.nodes.write.mode(mode).partitionBy("node_type").parquet(f"{path}/nodes")
    g.edges.write.mode(mode).partitionBy("edge_type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, node_types: Iterable[str] = (), edge_types: Iterable[str] = (), resolve: bool = True) -> Graph:
    """The stored graph, or its part of some types; edges with a missing endpoint are dropped unless told otherwise."""
    g = Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")).of_types(node_types, edge_types)
    return g.resolved() if resolve else g


def write_pivoted_csv(nodes: DataFrame, path: str, node_types: Iterable[str]) -> None:
    """A CSV folder a type, with a column for each of its tags and metrics."""
    for t in node_types:
        pivoted(nodes, t, *pivot_columns(nodes, t)).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{t}")


CLASS_RECORD, PACKAGE_RECORD = "name string, package string, kind string", "name string, classes long"


def write_record_csv(classes: DataFrame, path: str) -> None:
    """Inventory of classes (id, package, kind): a CSV folder of classes, one of packages with their numbers of classes."""
    parts = {"classes": classes.select(F.col("id").alias("name"), "package", "kind"), "packages": classes.groupBy(F.col("package").alias("name")).agg(F.count("*").alias("classes"))}
    for name, part in parts.items():
        part.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def read_record_csv(spark: SparkSession, path: str) -> DataFrame:
    """record ('class' or 'package'), name, package, kind and classes of a written inventory; a package's kind and a class's classes are null."""
    read = lambda name, schema: spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{name}")
    c = read("classes", CLASS_RECORD).select(F.lit("class").alias("record"), "name", "package", "kind", F.lit(None).cast("long").alias("classes"))
    p = read("packages", PACKAGE_RECORD).select(F.lit("package").alias("record"), "name", F.col("name").alias("package"), F.lit(None).cast("string").alias("kind"), "classes")
    return c.unionByName(p)


def write_graph_json(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").partitionBy("node_type").json(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("edge_type").json(f"{path}/edges")
    inverted_index(g.nodes).write.mode("overwrite").json(f"{path}/tags")


def xml_escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphml_lines(g: Graph) -> DataFrame:
    """(part, line) of a GraphML document; parts are ordered, lines inside a part are not."""
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_escaped(F.col("id")), F.lit('"/>')).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_escaped(F.col("source_id")), F.lit('" target="'), xml_escaped(F.col("target_id")), F.lit('"/>')).alias("line"))
    return n.union(e)


def dot_lines(g: Graph) -> DataFrame:
    """(part, line) of a DOT digraph's nodes and edges."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = g.nodes.select(F.lit(1).alias("part"), F.concat(quoted("id"), F.lit(";")).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.concat(quoted("source_id"), F.lit(" -> "), quoted("target_id"), F.lit(";")).alias("line"))
    return n.union(e)


def read_files(spark: SparkSession, path: str, suffixes: Iterable[str] = ()) -> DataFrame:
    """File nodes (path, name, text) of a folder and all below it, each file whole."""
    from weftline.operators.query import extension

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = f.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("content").cast("string").alias("text"))
    wanted = [s.lower() for s in suffixes]
    return f.filter(extension(F.col("name")).isin(wanted)) if wanted else f


def delete_graph(spark: SparkSession, path: str) -> None:
    """Deletes all nodes and edges of a stored graph; the schemas stay."""
    for part in ("nodes", "edges"):
        schema = spark.read.parquet(f"{path}/{part}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{part}")
