"""Drift at size: values are counted before they are binned."""

from pyspark.sql import functions as F

from claimscope.operators import drift as DR


def test_a_value_is_binned_once(spark):
    ref = spark.range(400).select((F.col("id") % 50).cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("c"))
    spec = DR.build_reference(ref, ["v", "c"])
    batch = spark.range(300).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 60).cast("double")).alias("v"), F.when(F.col("id") % 5 > 0, F.lit(float("nan"))).otherwise(F.lit(-0.0)).alias("c"))
    out = DR.score_batch(spec, batch, ["v", "c"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [feature" in plan and any("value" in line and "Aggregate [feature" in line for line in plan.splitlines())
    got = {r.feature: r for r in out.collect()}
    assert got["c"].current_share in (0.0, 1.0) and got["v"].psi > 0
