"""Migration plans (plan, phases, tasks, blocks) as frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BLOCKS = "plan string, phase string, task string, block string, block_type string, phase_no int, task_no int, block_no int"


class CyclicInclude(ValueError):
    """A plan that includes itself."""


def resolve_includes(name: str, read: Callable[[str], dict], above: tuple[str, ...] = ()) -> dict:
    """A plan document with the phases of its `includes` before its own; `read` gives the parsed document of a name."""
    if name in above:
        raise CyclicInclude(" -> ".join((*above, name)))
    doc = dict(read(name))
    phases = [p for x in doc.pop("includes", []) for p in resolve_includes(x, read, (*above, name)).get("phases", [])]
    return doc | {"phases": phases + list(doc.get("phases", []))}


def plan_blocks(spark: SparkSession, plans: list[dict]) -> DataFrame:
    """One row a block of parsed plan documents, with the numbers of phase, task and block."""
    rows = [
        (plan.get("name"), phase.get("name"), task.get("id", task.get("name")), block.get("name"), block.get("type"), i, j, k)
        for plan in plans
        for i, phase in enumerate(plan.get("phases", []))
        for j, task in enumerate(phase.get("tasks", []))
        for k, block in enumerate(task.get("blocks", []))
    ]
    return spark.createDataFrame(rows, BLOCKS)


def load_yaml_plan(path: str) -> dict:
    """A YAML plan with its includes, which are relative to it."""
    import os

    import yaml  # an optional dependency

    def read(name: str) -> dict:
        with open(name) as f:
            doc = yaml.safe_load(f) or {}
        return doc | {"includes": [os.path.join(os.path.dirname(name), x) for x in doc.get("includes", [])]}

    return resolve_includes(path, read)
