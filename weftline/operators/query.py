"""Predicates on nodes and edges. An empty type set means all; an empty tag list means none."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_types(df: DataFrame, col: str, types: Iterable[str] | None) -> DataFrame:
    types = list(types or ())
    return df.filter(F.col(col).isin(types)) if types else df


def newest_first(df: DataFrame, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("created_at"), *ties)


def has_tag(tag: str, col: str = "tags") -> Column:
    return F.coalesce(F.array_contains(col, tag), F.lit(False))


def has_any_tag(tags: Sequence[str], col: str = "tags") -> Column:
    if not tags:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(F.col(col), F.array(*map(F.lit, tags))), F.lit(False))


def has_all_tags(tags: Sequence[str], col: str = "tags") -> Column:
    if not tags:
        return F.lit(False)
    return reduce(Column.__and__, (has_tag(t, col) for t in dict.fromkeys(tags)))


def has_property(key: str, value: str | None = None, col: str = "properties") -> Column:
    """The key is there and, if a value is given, holds it as a string. Dotted keys are literal."""
    there = F.coalesce(F.map_contains_key(F.col(col), key), F.lit(False))
    return there if value is None else there & F.coalesce(F.col(col)[key] == value, F.lit(False))


def query_nodes(nodes: DataFrame, by: str = "ALL", node_type: str | None = None, tags: Sequence[str] = (), mode: str = "any") -> DataFrame:
    """BY_TYPE, BY_TAGS, BY_TYPE_AND_TAGS or ALL; tags match any or all."""
    tagged = {"any": has_any_tag, "all": has_all_tags}[mode](tags)
    choice = {"ALL": F.lit(True), "BY_TYPE": F.col("node_type") == node_type, "BY_TAGS": tagged, "BY_TYPE_AND_TAGS": (F.col("node_type") == node_type) & tagged}
    if by not in choice:
        raise ValueError(f"unknown query {by!r}")
    return nodes.filter(choice[by])


def touching(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("source_id") == node) | (F.col("target_id") == node))


def with_direction(edges: DataFrame, node: str) -> DataFrame:
    """Edges at a node, seen from it; a loop is outgoing."""
    return touching(edges, node).withColumn("direction", F.when(F.col("source_id") == node, "outgoing").otherwise("incoming"))


def normal_path(path: Column) -> Column:
    """Forward slashes, no repeated ones, no `/./`, no trailing one."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/(\\./)+", "/"), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def in_packages(package: Column, prefixes: Sequence[str]) -> Column:
    """The package is one of the prefixes or below it (at a dot). No prefixes: all, null packages too."""
    if not prefixes:
        return F.lit(True)
    return F.coalesce(reduce(Column.__or__, ((package == p) | package.startswith(p + ".") for p in prefixes)), F.lit(False))


def package_of(fqn: Column) -> Column:
    """All before the last dot; null without one."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def depth(package: Column) -> Column:
    """Dots and one; an empty or null package has depth 0."""
    return F.when(F.coalesce(package, F.lit("")) == "", 0).otherwise(F.size(F.split(package, r"\.")))


def filter_statistics(df: DataFrame, keep: Column) -> DataFrame:
    """Rows before, after and dropped by a filter, in one pass."""
    n, kept = F.count("*"), F.count_if(keep)
    return df.agg(n.alias("total"), kept.alias("kept"), (n - kept).alias("dropped"))


def add_tag(df: DataFrame, tag: str, when: Column, col: str = "tags") -> DataFrame:
    """Tags stay distinct and sorted."""
    old = F.coalesce(F.col(col), F.expr("array()").cast("array<string>"))
    return df.withColumn(col, F.when(when, F.array_sort(F.array_union(old, F.array(F.lit(tag))))).otherwise(old))


# Archive, source and configuration suffixes.
ARCHIVES = ("jar", "war", "ear", "zip")
EXTENSION_TAGS = {"java": "java_source", "class": "java_binary", "xml": "xml_config", "properties": "properties_config", "sql": "sql_script", "html": "html_page"}


def is_archive(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(ARCHIVES) + ")$")


def extension(name: Column) -> Column:
    """Lower-case suffix after the last dot of the last path part; empty without one."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def extension_tag(name: Column, tags: dict[str, str] = EXTENSION_TAGS) -> Column:
    """A literal map lookup; unknown extensions give null."""
    pairs = [F.lit(x) for kv in tags.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(name))


def glob_to_regex(pattern: str) -> str:
    """A gitignore-like glob: `**` crosses slashes, `*` and `?` don't; a pattern without an inner slash matches at any depth, one that ends in / a folder with all in it."""
    folder, body = pattern.endswith("/"), pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".\+^$()[]{}|" else c), i + 1
    head = "^" if "/" in pattern.rstrip("/") else "(^|.*/)"
    return head + out + ("/.*$" if folder else "(/.*)?$")


def ignored(path: Column, patterns: Sequence[str], hidden: bool = True) -> Column:
    """A glob matches or, with `hidden`, a part of the path starts with a dot."""
    tests = [path.rlike(glob_to_regex(p)) for p in patterns] + ([path.rlike(r"(^|/)\.[^/]")] if hidden else [])
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def truthy(value: str, kind: str) -> Column:
    """null: false; number: not 0; string: neither empty nor "false"; array: not empty."""
    v = F.col(value)
    test = {"boolean": v, "number": v != 0, "string": (v != "") & (F.lower(v) != "false"), "array": F.size(v) > 0}[kind]
    return F.coalesce(test, F.lit(False))


def evaluate(df: DataFrame, expression: str) -> Column:
    """A boolean SQL expression over the columns; a blank one is true, null is false."""
    return F.coalesce(F.expr(expression).cast("boolean"), F.lit(False)) if expression.strip() else F.lit(True)
