"""Parquet scans of the driver tables, with explicit column lists so pruning reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view (for `spark.sql` users)."""
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
