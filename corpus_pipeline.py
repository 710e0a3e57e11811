"""Corpus pipeline: stages over the documents table, each one of the operators of paymatch.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paymatch.llm import decontaminate, mixing, near_dups, quality, sharding
from paymatch.llm.store import save


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (MinHash LSH forest, 85 per cent)."""
    return near_dups.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go (spaced seeds)."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix to the sources' target weights takes them."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shards(docs)


STAGES = [("quality_classifier", good_quality), ("minhash_near_dedup", dedup),
          ("benchmark_decontamination", decontaminated), ("source_mixing", mixed), ("sharding", sharded)]
#: Hashing and trained models are part of the stages, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
