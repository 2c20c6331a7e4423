"""A training corpus from documents: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of documents;
the last adds shard and slot, which replace columns so named. Every stage takes an empty table, repeated rows, texts of any
length, columns of any other names, and nulls as it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, quality, sharding, simhash
from tessera.llm.scratch import materialize, settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds of their language and source; null text goes, other nulls stay."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies; rows without doc_id stay, repeated ones become one."""
    settle(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item; rows without doc_id cannot be named and stay."""
    settle(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share asks for; null source is a source, documents without words go."""
    settle(spark)
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; null language, source and doc_id come first, ties share their places."""
    settle(spark)
    return sharding.shard_documents(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL cannot express SimHash and alignment; tests/llm/test_pipeline.py holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, "stage")
    return docs
