"""Corpus pipeline: documents to scored, deduplicated, decontaminated, mixed and sharded documents.

Each stage takes `(spark, docs, sf_dir)` and returns a DataFrame. Stages are written as Parquet and read again as the next one's
input; `run` does so below `spark.checkpoint.dir`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penstock.llm.common import table
from penstock.llm.op4_quality import fit_rules, keep_good
from penstock.llm.op5_mixing import mix_documents
from penstock.llm.op6_decontaminate import drop_leaks
from penstock.llm.op9_sharding import SHARDS, shard_documents
from penstock.llm.op10_jaccard_join import keep_one
from penstock.sources.staging import stage as written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more; it is fitted on the labelled rows of this input."""
    return keep_good(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id. Documents without words stay."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that tile no benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with `shard` and `slot`."""
    return shard_documents(docs, [1.0] * SHARDS)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "corpus")
    return docs
