"""Exact linear-interpolation quantiles from value counts, without one task per group holding all values.

For each group: distinct values with their counts, the number of rows below each
value (a distributed running sum, see ``cumulative_before``), then the two order
statistics around position q*(n-1) and the interpolation
``t >= 0.5 ? b - (b - a) * (1 - t) : a + (b - a) * t`` (the rule of the
reference's array library, so edges agree to the last bit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.evaluate import cumulative_before


def linspace_quantiles(n_bins: int) -> list[float]:
    """0, step, 2*step, ..., 1 with step = 1/n_bins and the end point exact."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def exact_quantiles(value_counts: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys..., qi, q, edge) for every quantile in ``qs``; ``value_counts`` = (keys, value, n)."""
    stats = value_counts.groupBy(*keys).agg(F.sum("n").alias("__N"), F.min("value").alias("__lo"),
                                            F.max("value").alias("__hi"))
    vc = value_counts.join(F.broadcast(stats), keys)
    ranked = cumulative_before(vc, keys, "value", ["n"], lo=F.col("__lo"), hi=F.col("__hi"))
    q_arr = F.array(*[F.lit(float(q)) for q in qs])
    idx = F.sequence(F.lit(0), F.lit(len(qs) - 1))
    pos = lambda i: F.element_at(q_arr, i + 1) * (F.col("__N") - 1).cast("double")
    prev = lambda i: F.floor(pos(i))
    nxt = lambda i: F.least(prev(i) + 1, F.col("__N") - 1)
    covers = lambda r: (F.col("n_before") <= r) & (r < F.col("n_before") + F.col("n"))
    hits = ranked.select(
        *keys, "value",
        F.filter(idx, lambda i: covers(prev(i))).alias("as_lo"),
        F.filter(idx, lambda i: covers(nxt(i))).alias("as_hi"))
    lo = hits.select(*keys, "value", F.explode("as_lo").alias("qi")).withColumnRenamed("value", "a")
    hi = hits.select(*keys, "value", F.explode("as_hi").alias("qi")).withColumnRenamed("value", "b")
    j = lo.join(hi, [*keys, "qi"]).join(F.broadcast(stats.select(*keys, "__N")), keys)
    q = F.element_at(q_arr, F.col("qi") + 1)
    p = q * (F.col("__N") - 1).cast("double")
    t = p - F.floor(p)
    a, b = F.col("a"), F.col("b")
    edge = F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)
    return j.select(*keys, F.col("qi").cast("int").alias("qi"), q.alias("q"), edge.alias("edge"))
