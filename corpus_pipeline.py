"""The corpus pipeline: documents in, coded token shards out.

Each stage works on all rows that its predecessor kept. The first four return the
columns of `documents`; the last returns one row a document of the coded output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import remove_leaks
from weftline.llm.mixing import mix_documents
from weftline.llm.ngram_join import jaccard_components
from weftline.llm.quality_rules import filter_quality
from weftline.llm.queries import tokenizer_path
from weftline.llm.shared import Scratch
from weftline.llm.token_output import read_index, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; rows without an id stay.

    Rows that share an id are documents of their own: one of them (the least by text hash)
    stands for the id, the others come after all ids. Repeated rows are copies.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    many, last = ids.agg(F.count_if(F.col("n") > 1), F.max("doc_id")).first()
    if many:
        scratch = Scratch(spark, "repeated")
        again = ids.filter("n > 1").select("doc_id")
        # numbered rows are written, so that a number stays with its row
        rows = docs.join(again, "doc_id", "left_semi").select("*", F.monotonically_increasing_id().alias("row_"))
        rows = scratch.write(rows, "rows")
        first = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "row_"))["row_"].alias("row_")).select("row_", F.lit(True).alias("first_"))
        rows = rows.join(first, "row_", "left").select(*docs.columns, F.when(F.col("first_"), F.col("doc_id")).otherwise(F.lit(last + 1) + F.col("row_")).alias("node_"))
        docs = docs.join(again, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").alias("node_")).union(rows)
    else:
        docs = docs.withColumn("node_", F.col("doc_id"))
    groups = jaccard_components(docs, id_col="node_")
    gone = groups.filter("doc_id != component_id").select(F.col("doc_id").alias("node_"))
    return docs.join(gone, "node_", "left_anti").drop("node_")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents of small sources come twice, cut ones have their own n_chars."""
    mixed = mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The coded token shards, as read back: doc_id, start, n_tokens and ids_crc32 of each row."""
    path = f"{Scratch(spark, 'pipeline').path}/tokens"
    write_tokens(docs, path, tokenizer_path())
    return read_index(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("encode", encode)]

# the tokenizer and the coded files are beyond SQL; tests/llm has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, a written table between any two."""
    scratch, before = Scratch(spark, "stages"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:  # its reader is written
            scratch.drop(before)
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    scratch.drop(before)
    return out
