"""Corpus pipeline: quality rules, near-dedup, decontamination, PII masking, SentencePiece ids; each stage over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimscope.llm import decontaminate, near_dedup, pieces, pii, quality_rules
from claimscope.llm.common import table
from claimscope.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("quality rules", quality_stage), ("minhash near-dedup", dedup_stage),
          ("benchmark decontamination", decontamination_stage), ("pii", pii_stage), ("sentencepiece", tokens_stage)]

#: SQL cannot express the signatures and the models; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order; each result is written as Parquet to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{k}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
