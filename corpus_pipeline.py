"""The corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, mixing, token-ID output.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps, with the columns of documents; the last
writes the token store and gives doc_id, start, n_tokens and ids_crc32 of each document as read back from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import materialize
from tidegauge.llm.fm_index import decontaminate
from tidegauge.llm.jaccard_join import keep_one
from tidegauge.llm.quality_rules import accept
from tidegauge.llm.queries import tokenizer_file
from tidegauge.llm.source_mix import sample
from tidegauge.llm.token_store import store_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked ones."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut from their texts."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the calibrated probability of their source, language and topic."""
    return sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's digests."""
    return store_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mixing), ("token-ID output", token_output)]

#: Hashed multinomials, raking and tokenisation are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
