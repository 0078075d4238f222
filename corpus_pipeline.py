"""The cleaning pipeline over `documents`, from raw text to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.llm import line_dedup, ngram_join, packing, pii, quality_rules, queries
from usagelens.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; every document stays, n_chars follows the text."""
    return line_dedup.drop_repeated_lines(docs).drop("n_lines", "n_deleted").selectExpr("doc_id", "text", "lang", "source", "CAST(char_length(text) AS BIGINT) AS n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by shingle similarity, the one of smallest doc_id stays."""
    stays = ngram_join.similar_documents(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").dropDuplicates(["doc_id", "text"])


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.sanitise(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(char_length(text) AS BIGINT) AS n_chars")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, a row per piece of a document with its ids."""
    return packing.pack(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("personal", personal), ("packing", sequences)]
#: Packing runs on token ids, which SQL cannot make. tests/llm run the whole pipeline on planted cases, and hold the operators of the line,
#: quality and near stages against SQL and packing against the tokenizers library, that of the personal stage only in single cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to `documents`; each result is written as Parquet and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut_lineage(docs) if i + 1 < len(STAGES) else docs
    return docs
