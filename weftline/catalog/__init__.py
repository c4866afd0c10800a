"""The registered graph, text-metric and log queries, each with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a Tables object; `sql` may use the views of tables.PRELUDE."""

    def put(f: Callable) -> Callable:
        from weftline.catalog.tables import Tables, oracle

        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return put


def load() -> None:
    from weftline.catalog import graph, logs, more, rules, sinks, structure, texts  # noqa: F401


load()
