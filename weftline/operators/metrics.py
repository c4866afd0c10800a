"""Counts and metric distributions of graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.graph import Graph


def _one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row side by side, by a union instead of a join."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*(F.max(c).alias(c) for c in out.columns))


def graph_statistics(g: Graph) -> DataFrame:
    """One row: nodes, node types, edges, edge types and nodes with a tag."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.countDistinct("node_type").alias("node_types"), F.count_if(F.size("tags") > 0).alias("tagged_nodes"))
    e = g.edges.agg(F.count("*").alias("edges"), F.countDistinct("edge_type").alias("edge_types"))
    return _one_row(n, e)


def statistics_by_type(g: Graph) -> DataFrame:
    n = g.nodes.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("count")).withColumn("element", F.lit("node"))
    return n.unionByName(g.edges.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("count")).withColumn("element", F.lit("edge")))


def service_statistics(g: Graph, class_type: str = "java_class", file_type: str = "file") -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("node_type") == class_type).alias("class_nodes"), F.count_if(F.col("node_type") == file_type).alias("file_nodes"))
    return _one_row(n, g.edges.agg(F.count("*").alias("total_edges")))


def metric_values(nodes: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """(id, metric, value) of the named metrics, or all; absent and null ones have no row."""
    v = nodes.select("id", F.explode("metrics").alias("metric", "value")).filter("value is not null")
    return v.filter(F.col("metric").isin(list(names))) if names else v


def metric_statistics(values: DataFrame) -> DataFrame:
    """Count, minimum, maximum, mean, median (mean of the middle two) and population deviation of each metric."""
    v = F.col("value")
    return values.groupBy("metric").agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.median(v).alias("median"), F.stddev_pop(v).alias("std_dev"))


def outliers(values: DataFrame, k: float = 2.0) -> DataFrame:
    """Values farther than k deviations from their metric's mean; the statistics are one row a metric."""
    s = metric_statistics(values).select("metric", "avg", "std_dev")
    return values.join(s, "metric").filter(F.abs(F.col("value") - F.col("avg")) > k * F.col("std_dev")).select("id", "metric", "value")


def pivot_columns(nodes: DataFrame, node_type: str) -> tuple[list[str], list[str]]:
    """Sorted tags and metric names of a type: the header of its export, as many as there are names."""
    n = nodes.filter(F.col("node_type") == node_type)
    tags = sorted(r[0] for r in n.select(F.explode("tags")).distinct().collect())
    return tags, sorted(r[0] for r in n.select(F.explode(F.map_keys("metrics"))).distinct().collect())


def pivoted(nodes: DataFrame, node_type: str, tags: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """id, type, label, a boolean a tag and a value a metric: a projection, no shuffle."""
    cols = [F.coalesce(F.array_contains("tags", t), F.lit(False)).alias(f"tag_{t}") for t in tags]
    cols += [F.col("metrics")[m].alias(f"metric_{m}") for m in metrics]
    return nodes.filter(F.col("node_type") == node_type).select("id", F.col("node_type").alias("type"), F.col("display_label").alias("label"), *cols)


def validate(nodes: DataFrame, required: Sequence[str] = (), most: int = 255) -> DataFrame:
    """Violations (id, rule, key): required keys, key form and length, null values, flags and metrics that don't parse, negative metrics."""
    keys = F.map_keys("properties")
    checks = [
        F.transform(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), keys), lambda k: F.struct(F.lit("required").alias("rule"), k.alias("key"))),
        F.transform(F.filter(keys, lambda k: ~k.rlike(r"^[A-Za-z_][A-Za-z0-9_.\-]*$") | (F.length(k) > most)), lambda k: F.struct(F.lit("key_form").alias("rule"), k.alias("key"))),
        F.transform(F.map_keys(F.map_filter("properties", lambda _, v: v.isNull())), lambda k: F.struct(F.lit("null_value").alias("rule"), k.alias("key"))),
        F.transform(F.map_keys(F.map_filter("properties", lambda k, v: k.rlike(r"(^|\.)is_") & ~F.coalesce(F.lower(v).isin("true", "false"), F.lit(True)))), lambda k: F.struct(F.lit("not_boolean").alias("rule"), k.alias("key"))),
        F.transform(F.map_keys(F.map_filter("properties", lambda k, v: k.startswith("metrics.") & v.isNotNull() & v.try_cast("double").isNull())), lambda k: F.struct(F.lit("not_numeric").alias("rule"), k.alias("key"))),
        F.transform(F.map_keys(F.map_filter("metrics", lambda _, v: v < 0)), lambda k: F.struct(F.lit("negative").alias("rule"), k.alias("key"))),
    ]
    return nodes.select("id", F.explode(F.concat(*checks)).alias("v")).select("id", "v.rule", "v.key")
