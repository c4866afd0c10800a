"""Mixing sources to target weights, on DataFrame operations only.

Every document gets a hash-random key from its id and its text, so rows without an id and
rows that share one are spread too. Each source's keys are cut into equal ranges, so many
that a range has RANGE_ROWS rows at most on average (keys are uniform, so a source that holds a third of all rows is spread as
evenly as the others). Prefix sums of sizes are taken over the ranges' totals and then
inside each range, so no task holds a source. Where the prefix passes the source's
budget the mix ends, exactly; a budget above the source's size starts another epoch.

Targets. A share `budget` of the total size is divided by weight; no target exceeds
`most` times its source's size, and what is cut off is divided again by weight among
the others. That is water filling: target = min(most * size, level * weight). With
sources in order of most * size / weight, the level follows from running sums over
one row per source. Sources are ordered by code point, null last; weights repeat in
that order. One row per source is a mix's configuration, and the only unpartitioned
windows are over those rows.

Sizes are numbers of `[^\\x20\\x09-\\x0D]+` words. Null and empty texts: size 0, never
taken. Ties in the key are ordered by id; rows that are equal in id and text are
interchangeable, each has its own place. An empty table gives no rows. Columns of the
input stay as they are; `mix_sources` replaces those that have the names of its own,
`mix_documents` keeps all. The text is read only for its words and hash: where the
caller doesn't ask for it, it is not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, LEAST_LOG2 = 20_000, 12
KEY_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(id_col: Column, text: Column, seed: str) -> Column:
    """60 bits of an MD5 of id and text, the same on every run and in any engine."""
    none = F.lit("")
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), none), F.lit(":"), F.md5(F.coalesce(text.cast("string"), none)), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def ranges_log2(docs: DataFrame) -> int:
    """Ranges of a source, as a power of two, from the number of all rows (which files tell without reading texts)."""
    return min(KEY_BITS, max(LEAST_LOG2, (docs.count() // RANGE_ROWS).bit_length() + 2))


def source_targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """From one row per source (mix_source, mix_size): mix_weight and mix_target."""
    n = len(weights)
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    s = sources.withColumn("mix_weight", F.element_at(F.array(*map(F.lit, weights)), (place % n + 1).cast("int")).cast("long"))
    s = s.withColumn("mix_cap", F.col("mix_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("mix_cap") / F.col("mix_weight"), F.col("mix_source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level if this source and all later ones are not full
    level = (F.lit(float(budget)) * F.sum("mix_size").over(everything) - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / (F.sum("mix_weight").over(everything) - F.coalesce(F.sum("mix_weight").over(before), F.lit(0)))
    s = s.withColumn("mix_level", level)
    s = s.withColumn("mix_open", F.col("mix_level") * F.col("mix_weight") <= F.col("mix_cap"))
    # the first such source has the level; later ones compute lower ones, so it is the largest
    s = s.withColumn("mix_level", F.max(F.when(F.col("mix_open"), F.col("mix_level"))).over(everything))
    target = F.least(F.col("mix_cap"), F.coalesce(F.col("mix_level") * F.col("mix_weight"), F.col("mix_cap")))
    return s.select("mix_source", "mix_size", "mix_weight", target.alias("mix_target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The input's columns with mix_size, mix_source_size, mix_target and mix_taken (words the mix takes, repeats counted)."""
    if not weights or min(weights) <= 0 or budget < 0 or most <= 0:
        raise ValueError("weights and most must be above 0, budget not below 0")
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("mix_")))
    source, bits = F.col(source_col).cast("string"), ranges_log2(docs)
    d = docs.select("*", n_words(F.col(text_col)).alias("mix_size"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("mix_s"), mix_key(F.col(id_col), F.col(text_col), seed).alias("mix_key"))
    d = d.withColumn("mix_range", F.shiftright("mix_key", KEY_BITS - bits))
    ranges = d.groupBy("mix_s", "mix_range").agg(F.sum("mix_size").alias("mix_sum"))
    sources = ranges.groupBy("mix_s").agg(F.sum("mix_sum").alias("mix_size"))
    sources = sources.withColumn("mix_source", F.when(F.col("mix_s") != "", F.col("mix_s")))
    targets = source_targets(sources, weights, budget, most).select(F.coalesce("mix_source", F.lit("")).alias("mix_s"), F.col("mix_size").alias("mix_source_size"), "mix_target")
    earlier = Window.partitionBy("mix_s").orderBy("mix_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("mix_s", "mix_range", F.coalesce(F.sum("mix_sum").over(earlier), F.lit(0)).alias("mix_base")).join(targets, "mix_s")
    d = d.join(bases, ["mix_s", "mix_range"])
    inside = Window.partitionBy("mix_s", "mix_range").orderBy("mix_key", id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("mix_base") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    goal = F.floor(F.round("mix_target", 6)).cast("long")
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(goal / F.col("mix_source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("mix_source_size")
    taken = epochs * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), rest - F.col("mix_before")))
    d = d.withColumn("mix_before", before).withColumn("mix_taken", taken.cast("long"))
    return d.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken")


def mix_documents(docs: DataFrame, text_col: str = "text", **mix) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns of the input.

    The document at which a source's budget ends is cut after the last word that fits.
    """
    names = {c: f"input_{i}" for i, c in enumerate(docs.columns) if c.lower().startswith("mix_")}
    d = mix_sources(docs.withColumnsRenamed(names), text_col=text_col, **mix).filter("mix_taken > 0")
    d = d.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("mix_taken") / F.col("mix_size")).cast("int"))))
    left = (F.col("mix_taken") - (F.col("mix_copy") - 1) * F.col("mix_size")).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0)), F.lit(1), left), "")
    text = F.when(left < F.col("mix_size"), cut).otherwise(F.col(text_col)).alias(text_col)
    return d.select(*(text if c == text_col else F.col(names.get(c, c)).alias(c) for c in docs.columns))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, 2::DOUBLE * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), l AS (
  SELECT *,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER filling, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER filling, 0)) AS level
  FROM s WINDOW filling AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT max(level) FILTER (level * w <= cap) AS level FROM l),
t AS (
  SELECT source, source_size, least(cap, coalesce(f.level * w, cap)) AS target, floor(round(least(cap, coalesce(f.level * w, cap)), 6))::BIGINT AS goal
  FROM s, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.goal,
         CASE WHEN t.source_size > 0 THEN t.goal // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
