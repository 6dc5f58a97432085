"""Shared plan builders: cleaned claims, the feature matrix, the scored table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.text import char_length, repair_mojibake, word_count
from claimscope.operators.clean import ClaimCleaner, CleanerModel
from claimscope.operators.features import EncoderModel, FeatureEncoder
from claimscope.session import compiled_in_parts, r6
from claimscope.sources.claims import claim_base, derive_claims, raw_claims
from claimscope.sources.tables import read_table


def document_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text features once per document (repaired text), instead of once per claim copy."""
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    t = repair_mojibake("text")
    return docs.select(F.col("doc_id").alias("__doc"),
                       char_length(t).alias("issue_desc_length"),
                       word_count(t).alias("issue_desc_word_count"))


def claims_for_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims without the narrative, carrying its per-document text statistics.

    Kept are the narrow base rows, joined once: every fit and the matrix derive the claim columns that they read from them.
    """
    compiled_in_parts(spark)
    base = claim_base(spark, sf_dir, "doc_key")
    stats = document_text_stats(spark, sf_dir)
    rows = persisted(base.join(stats, base.doc_key == stats["__doc"], "left").drop("__doc")
                     .fillna({"issue_desc_length": 0, "issue_desc_word_count": 0}))
    return derive_claims(rows, "issue_desc_length", "issue_desc_word_count")


def spread(df: DataFrame) -> DataFrame:
    """Text-heavy inputs stored in few large files: spread rows over all cores before per-row work.

    Only when the scan yields fewer partitions than the cluster's parallelism (a metadata
    check); a large table already arrives in many splits and is left alone.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def persisted(df: DataFrame) -> DataFrame:
    """Reuse within one job (fit then transform); recomputable from lineage on executor loss."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fitted_cleaner(raw: DataFrame) -> CleanerModel:
    return ClaimCleaner().fit(raw)


def cleaned_claims(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    raw = raw_claims(spark, sf_dir, with_text=with_text)
    return fitted_cleaner(raw).transform(raw)


def feature_matrix(spark: SparkSession, sf_dir: str, keep=("claim_id", "claim_key")) -> tuple[DataFrame, EncoderModel]:
    """Cleaned -> derived -> encoded -> finalised; maps fitted on all rows (fit_scope=all)."""
    raw = claims_for_features(spark, sf_dir)
    cleaned = fitted_cleaner(raw).transform(raw)
    enc = FeatureEncoder().fit(cleaned)
    return enc.transform(cleaned, keep=keep), enc


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column at 1e-6 (same rule as the oracle SQL)."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def ts_text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")
