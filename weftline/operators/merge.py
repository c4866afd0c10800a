"""Merge policies for repeated observations, and upserts of whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place_", F.row_number().over(w)).filter("place_ = 1").drop("place_")


def first_wins(df: DataFrame, keys: Sequence[str], order: str, *ties: str) -> DataFrame:
    return _pick(df, keys, [F.asc_nulls_last(order), *map(F.asc_nulls_last, ties)])


def last_wins(df: DataFrame, keys: Sequence[str], order: str, *ties: str) -> DataFrame:
    return _pick(df, keys, [F.desc_nulls_last(order), *map(F.asc_nulls_last, ties)])


def merge_max(x: str) -> Column:
    """Numeric maximum, at least 0; no values: 0."""
    return F.greatest(F.coalesce(F.max(x), F.lit(0)), F.lit(0))


def merge_or(x: str) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def merge_and(x: str) -> Column:
    return F.coalesce(F.bool_and(x), F.lit(False))


# Complexity levels in order, and the numbers of the stored ones.
LEVELS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
LEVEL_METRICS = {"LOW": 3.0, "MEDIUM": 6.0, "HIGH": 9.0}


def level_ordinal(level: Column) -> Column:
    """0 to 4; null counts as NONE, an unknown label as MEDIUM."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), F.upper(F.trim(level)))
    return F.when(level.isNull(), 0).when(at == 0, 2).otherwise(at - 1).cast("int")


def merge_complexity(level: str) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(level_ordinal(F.col(level))), F.lit(0)) + 1)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each id by updated_at, new ones before old at a tie; the first created_at stays."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    by_id = Window.partitionBy("id")
    both = both.withColumn("born_", F.min("created_at").over(by_id))
    both = both.withColumn("place_", F.row_number().over(by_id.orderBy(F.desc_nulls_last("updated_at"), F.desc("new_"))))
    return both.filter("place_ = 1").withColumn("created_at", F.col("born_")).select(old.columns)


def insert_edges(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("source_id", "target_id", "edge_type"), order: str = "created_at") -> DataFrame:
    """New edges whose key is not there yet, the first of each, after the old ones."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(first_wins(fresh, keys, order).select(old.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes in ids (id), and without the edges at them."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    e = e.join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e.select(edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame, keys: Sequence[str] = ("source_id", "target_id", "edge_type")) -> DataFrame:
    """The edges whose keys are not among `gone`."""
    return edges.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def delete_edges_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that touch none of the nodes."""
    ids = nodes.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")


def patch_map(old: Column, patch: Column) -> Column:
    """A JSON merge patch of flat maps: null values remove their keys, others replace."""
    old, patch = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(patch, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))


def set_metric(metrics: Column, name: str, value: Column) -> Column:
    """A double; null removes the name."""
    metrics = F.coalesce(metrics, F.create_map().cast("map<string,double>"))
    rest = F.map_filter(metrics, lambda k, _: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value.cast("double"))))


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """New rows whose content is new or differs in MD5 from the old row of that key; old: (key, md5)."""
    seen = old.select(F.col(key), F.col("md5").alias("md5_"))
    now = new.withColumn("md5", F.md5(F.col(content)))
    return now.join(seen, key, "left").filter(F.col("md5_").isNull() | (F.col("md5_") != F.col("md5"))).drop("md5_")


def skip_existing(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return new.join(known.select(key), key, "left_anti")


def stale(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items (key, modified_at) without a result (key, executed_at) at or after their change."""
    last = results.groupBy(key).agg(F.max("executed_at").alias("executed_at"))
    return items.join(last, key, "left").filter(F.col("executed_at").isNull() | (F.col("executed_at") < F.col("modified_at"))).select(items.columns)


def flatten_keys(nested: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in nested.items():
        out |= flatten_keys(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


def nest_keys(flat: dict[str, object] | None) -> dict:
    """Dotted keys as nested maps; a map replaces a plain value that stands in its way."""
    out: dict = {}
    for key, value in (flat or {}).items():
        at = out
        *path, last = key.split(".")
        for part in path:
            at[part] = at = at[part] if isinstance(at.get(part), dict) else {}
        at[last] = value
    return out


def nested_json(properties: Column, keys: Sequence[str]) -> Column:
    """Flat dotted properties of known keys as one nested JSON string, without the absent ones."""

    tree = nest_keys({k: k for k in keys})

    def column(t: dict) -> Column:
        return F.struct(*((column(v) if isinstance(v, dict) else properties[v]).alias(k) for k, v in t.items()))

    return F.to_json(column(tree))
