"""A property graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """`nodes` has id, node_type, display_label, properties, metrics, tags, created_at, updated_at; `edges` has source_id, target_id, edge_type, properties, created_at."""

    nodes: DataFrame
    edges: DataFrame

    def of_types(self, node_types: Iterable[str] = (), edge_types: Iterable[str] = ()) -> Graph:
        """The nodes and edges of the given types; an empty set means all. Both filters reach a Parquet scan."""
        from weftline.operators.query import by_types

        return Graph(by_types(self.nodes, "node_type", node_types), by_types(self.edges, "edge_type", edge_types))

    def resolved(self) -> Graph:
        """Without edges that have an endpoint outside the nodes: two semi joins, no column of `nodes` but the id moves."""
        ids = self.nodes.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
        e = e.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        return Graph(self.nodes, e.select(self.edges.columns))

    def induced(self, node_types: Iterable[str] = (), edge_types: Iterable[str] = ()) -> Graph:
        """The subgraph on nodes of some types, with edges of some types between them."""
        return self.of_types(node_types, edge_types).resolved()

    def reversed(self) -> Graph:
        e = self.edges
        swap = {"source_id": "target_id", "target_id": "source_id"}
        return Graph(self.nodes, e.select(*(F.col(swap.get(c, c)).alias(c) for c in e.columns)))

    def lifted(self, groups: DataFrame) -> DataFrame:
        """Distinct edges (source_id, target_id) between the groups of the endpoints; groups: (id, group). Edges inside a group and of ungrouped nodes fall away."""
        e = self.edges.select("source_id", "target_id").distinct()
        e = e.join(groups.select(F.col("id").alias("source_id"), F.col("group").alias("s")), "source_id")
        e = e.join(groups.select(F.col("id").alias("target_id"), F.col("group").alias("t")), "target_id")
        return e.filter("s != t").select(F.col("s").alias("source_id"), F.col("t").alias("target_id")).distinct()
