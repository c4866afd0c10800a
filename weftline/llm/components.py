"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a min per node (partially aggregated before its shuffle) and a join back,
which adaptive execution splits where a hub is hot. Every round is a written table in
the shared folder; the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, component) of every linked node that is not its component's smallest; links: (u, v), u != v."""
    e = scratch.write(links.select("u", "v").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, k = now, k + 1
        e = scratch.write(_small(_large(e)).filter("u != v").distinct(), f"{name}-{k}")
    scratch.drop(*(f"{name}-{i}" for i in range(k)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
