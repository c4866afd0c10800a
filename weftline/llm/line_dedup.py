"""Cross-site boilerplate lines by distinct-site spread, on DataFrame operations only.

A line is a `\\n`-separated piece of a text, compared without leading and trailing
white space (space, 0x09, 0x0B-0x0D); blank lines are never boilerplate. A line is
boilerplate if it stands on `sites` or more distinct sites (null sites don't count).

The spread of every line hash is a HyperLogLog sketch, merged by aggregation: partial
sketches form before the shuffle, so the most common line costs one row a task. Only
lines whose estimate is within the sketch's error band of the threshold get exact
distinct counts, also partially aggregated. Removal joins line hashes, not texts; the
texts move once, by document.

Null and empty texts stay as they are, with no lines removed. Rows are judged as they
stand: repeated rows count one site. Rows with a null id are kept and cleaned like
others. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import Scratch

SITES = 5
LG_K = 12
# three standard errors of a sketch with 2^12 registers, as a share of the estimate
BAND = 3 * 1.04 / 2 ** (LG_K / 2)
WHITE = " \t\r\x0b\x0c"


def _hash(line: Column) -> Column:
    """128 bits of a trimmed line, as two independent 64-bit hashes."""
    line = F.btrim(line, F.lit(WHITE))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    d = docs.filter("text is not null").select("doc_id", "row_key", "site", F.explode(F.split("text", "\n")).alias("line"))
    return d.filter(F.btrim("line", F.lit(WHITE)) != "").select("doc_id", "row_key", "site", _hash(F.col("line")).alias("h")).select("doc_id", "row_key", "site", "h.a", "h.b")


def boilerplate_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (a, b) of the lines on `sites` or more sites; docs has doc_id, row_key, site and text.

    Both steps are written tables: joins with them shuffle either side anew, so that
    adaptive execution can split the line that is in a third of all texts.
    """
    lines, scratch = _lines(docs), Scratch(docs.sparkSession, "line-dedup")
    spread = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n"))
    margin = max(1.0, BAND * sites)
    spread = scratch.write(spread.filter(F.col("n") >= sites - margin), "spread")
    near = spread.filter(F.col("n") <= sites + margin).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("n"))
    found = spread.filter(F.col("n") > sites + margin).select("a", "b").union(exact.filter(F.col("n") >= sites).select("a", "b"))
    lines = scratch.write(found, "lines")
    scratch.drop("spread")
    return lines


def line_dedup(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text (its lines in order, joined by \\n) of each row."""
    if sites < 1:
        raise ValueError("sites must be at least 1")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(site_col).cast("string").alias("site"))
    src = src.withColumn("row_key", F.xxhash64("doc_id", "text"))
    gone = _lines(src).select("doc_id", "row_key", "a", "b").join(boilerplate_lines(src, sites), ["a", "b"], "left_semi")
    gone = gone.groupBy("row_key", F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    out = src.select("doc_id", "row_key", "text").join(gone.withColumnRenamed("row_key", "key"), (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("gone", _hash(x))))
    out = out.select("doc_id", "text", kept.alias("kept"))
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept")).cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - left).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), trimmed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM lines
), boiler AS (
  SELECT t FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT doc_id, pos, line, t IN (SELECT t FROM boiler) AS gone FROM trimmed
), kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       sha256(k.kept_text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
