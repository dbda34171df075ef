"""Raw documents to token ids: quality rules, near duplicates, benchmark decontamination, redaction, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Tables that are empty, rows
that repeat, and nulls go through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ondaspark.llm import byte_bpe, decontaminate, jaccard_join, pii, quality_rules
from ondaspark.llm.common import documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the learned decision list keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents in which no passage of the benchmark occurs."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "any")


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with personal data in the text replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return byte_bpe.digests(docs)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontaminate", decontamination), ("pii", redaction), ("byte_bpe", tokens)]
#: Stages rest on trained models and a tokenizer, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
