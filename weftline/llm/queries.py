"""The text operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.chat_format import digests, format_turns
from weftline.llm.decontaminate import find_leaks
from weftline.llm.html_extract import extract_pages
from weftline.llm.license_scan import license_scan
from weftline.llm.license_scan import oracle as license_sql
from weftline.llm.line_dedup import ORACLE as LINE_DEDUP_SQL
from weftline.llm.line_dedup import line_dedup
from weftline.llm.mixing import ORACLE as MIX_SQL
from weftline.llm.mixing import mix_sources
from weftline.llm.ngram_join import jaccard_components
from weftline.llm.quality_rules import ORACLE as QUALITY_SQL
from weftline.llm.quality_rules import quality_report
from weftline.llm.shared import Scratch
from weftline.llm.substring_dedup import ORACLE as SUBSTRING_SQL
from weftline.llm.substring_dedup import substring_dedup
from weftline.llm.token_output import read_index, write_tokens

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix_sources(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'op5').path}/tokens"
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_index(spark, path)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: Two turns that hold the template's own control strings.
CONFLICT = "\\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(rows.unionByName(extra)))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_html_extract,
        op3_license_scan,
        op4_source_mix,
        op5_token_output,
        op6_ngram_join,
        op7_chat_format,
        op8_line_dedup,
        op9_quality_rules,
        op10_decontaminate,
    )
}

#: A turn is written in 15 characters around role and text. A backslash in its text doubles its backslashes, a line's end
#: after the closing mark puts one before each control string too.
CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)
), e AS (
  SELECT *, contains(text, ' </turn>' || chr(10)) AS closes, length(text) - length(replace(text, chr(92), '')) AS backs,
         len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###' OR substr(text, i, 2) = ': ' OR substr(text, i, 8) = ' </turn>')) AS marks
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(role) + length(text) + backs + CASE WHEN closes THEN marks ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRING_SQL, "op7_chat_format": CHAT_SQL, "op3_license_scan": license_sql(), "op4_source_mix": MIX_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op9_quality_rules": QUALITY_SQL}
