"""Spark session settings and small plan helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import config as C


def build_session(master: str | None = None, app: str = "claimscope",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew-join splitting) and a UTC clock.

    On a cluster the master, memory and checkpoint folder come from the
    cluster's own defaults; only what is unset is filled in here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("CLAIMSCOPE_SHUFFLE_PARTITIONS")
    if (master or "").startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("CLAIMSCOPE_DRIVER_MEMORY", "8g"))
        parts = parts or 8
    if parts:  # a cluster keeps its own width unless told otherwise
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a scratch one only if unset on a local master (tests)."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="claimscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def compiled_in_parts(spark: SparkSession) -> None:
    """Wide projections of many expressions become methods that the JVM compiles: above 8,000 bytes of bytecode HotSpot only interprets
    a method, so Spark shall cut such a stage into the small methods of its row-wise form. A limit that the session sets stays."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for work that costs by the row: as many as the rows need, never fewer than the cluster runs at once.

    AQE sizes tasks by bytes, which says little about narrow rows with dear columns; an explicit number is left alone.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "left",
                max_broadcast_rows: int = C.MAX_BROADCAST_ROWS,
                known_rows: int | None = None) -> DataFrame:
    """Equi-join to a fitted lookup table, broadcasting it only below a checked size.

    Fitted state (medians, frequencies, levels) is one row per distinct level and
    is already materialised, so counting it is cheap; above the limit the join
    falls back to a shuffle join and AQE decides at run time.
    """
    rows = known_rows if known_rows is not None else lookup.count()
    side = F.broadcast(lookup) if rows <= max_broadcast_rows else lookup
    return df.join(side, on=on, how=how)


def r6(col):
    """Round half-up at 1e-6; the same expression is used in the DuckDB oracle."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
