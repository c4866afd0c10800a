"""Rules: column expressions with declared tag dependencies, planned once and run in one pass.

A rule requires tags, and where its condition holds it produces tags and metrics. The
planner orders rules topologically by tags, so a rule sees what its producers wrote
and no repeated passes are needed. Rules that do not depend on each other share a
level, and a level is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.merge import set_metric
from weftline.operators.query import has_all_tags


class CyclicRules(ValueError):
    """Rules that wait for each other's tags."""


@dataclass(frozen=True)
class Rule:
    name: str
    when: str
    produces: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    metrics: dict[str, str] = field(default_factory=dict, hash=False)


def levels(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules by the longest chain of producers below them; tags that no rule produces come from the input."""
    makers: dict[str, set[str]] = {}
    for r in rules:
        for t in r.produces:
            makers.setdefault(t, set()).add(r.name)
    left = {r.name: r for r in rules}
    needs = {r.name: set().union(*(makers.get(t, set()) for t in r.requires)) - {r.name} for r in rules}
    out: list[list[Rule]] = []
    while left:
        ready = sorted(n for n in left if not needs[n] & left.keys())
        if not ready:
            raise CyclicRules(", ".join(sorted(left)))
        out.append([left.pop(n) for n in ready])
    return out


def apply_rules(nodes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The nodes with all produced tags and metrics. Conditions and metrics are SQL over the nodes' columns."""
    for group in levels(rules):
        fires = {r.name: (has_all_tags(r.requires) if r.requires else F.lit(True)) & F.coalesce(F.expr(r.when), F.lit(False)) for r in group}
        none = F.expr("array()").cast("array<string>")
        made = [F.when(fires[r.name], F.array(*map(F.lit, r.produces))).otherwise(none) for r in group if r.produces]
        tags = F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", none), *made)))
        metrics: Column = F.col("metrics")
        for r in group:
            for name, value in r.metrics.items():
                metrics = F.when(fires[r.name], set_metric(metrics, name, F.expr(value))).otherwise(metrics)
        nodes = nodes.withColumns({"tags": tags, "metrics": metrics})
    return nodes


def dependency_frames(spark, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rule, tag) of what rules produce and of what they require."""
    made = [(r.name, t) for r in rules for t in r.produces]
    need = [(r.name, t) for r in rules for t in r.requires]
    return spark.createDataFrame(made, "rule string, tag string"), spark.createDataFrame(need, "rule string, tag string")
