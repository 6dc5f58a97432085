"""Subgroup reports with GROUPING SETS (A26 fairness, A27 subgroup evidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators.evaluate import safe_div

SPREAD_LIMIT = 0.05  # five points of F1 between the best and worst level of one dimension


def group_fairness(scored: DataFrame, dims) -> DataFrame:
    """F1 and false-decline rate (FP / actual negatives) per level; flag a spread > 5 points."""
    dims = list(dims)
    pred = (F.col("p") >= F.col("threshold")).cast("int")
    s = scored.withColumn("pred", pred)
    tp = F.count_if((F.col("pred") == 1) & (F.col("y") == 1))
    fp = F.count_if((F.col("pred") == 1) & (F.col("y") == 0))
    fn = F.count_if((F.col("pred") == 0) & (F.col("y") == 1))
    g = s.groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
        F.count(F.lit(1)).alias("n"),
        safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_declined"),
        safe_div(fp, F.count_if(F.col("y") == 0)).alias("false_decline_rate"))
    name = F.lit(dims[-1])
    for d in reversed(dims[:-1]):
        name = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(name)
    level = F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit("nan"))
    out = g.select(name.alias("dimension"), level.alias("level"), "n", "f1_declined", "false_decline_rate")
    w = Window.partitionBy("dimension")  # over the levels of one dimension (a small side)
    return out.withColumn("spread_flag", (F.max("f1_declined").over(w) - F.min("f1_declined").over(w))
                          > F.lit(SPREAD_LIMIT))


def subgroup_evidence(raw: DataFrame, dims) -> DataFrame:
    """Decline rate and n per level of each dimension, one pass with GROUPING SETS."""
    dims = list(dims)
    y = (F.col(C.TARGET) == C.POSITIVE_CLASS).cast("int")
    g = raw.withColumn("__y", y).groupingSets([[d] for d in dims], *dims).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("decline_rate"))
    name = F.lit(dims[-1])
    for d in reversed(dims[:-1]):
        name = F.when(F.col(f"__g_{d}") == 0, F.lit(d)).otherwise(name)
    level = F.coalesce(*[F.col(d).cast("string") for d in dims], F.lit("nan"))
    return g.select(name.alias("dimension"), level.alias("level"), "n", "decline_rate")
