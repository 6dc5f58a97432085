"""Neighbour purity (X4), masked narratives (A12) and clipped ratios (A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import clean as CL
from claimscope.operators import quality as Q
from claimscope.operators.neighbours import K, neighbour_purity
from claimscope.plans.claims_q import CLAIMS, CLAIMS_NT, _DIAG_NOTNA, _RATIO_SRC
from claimscope.plans.common import round_doubles, spread
from claimscope.plans.registry import query, with_ctes
from claimscope.plans.sql_claims import CURRENCY, r6
from claimscope.sources.claims import raw_claims
from claimscope.sources.tables import read_table

#: Whole steps of each amount that count as one unit of distance; one diagnostic field counts 100.
_UNITS = {"rrp": 1, "excessFee": 10, "balanceRRP": 1}
_VECTOR_SQL = ", ".join([f"coalesce(CAST(floor({c} * {u} + 1e-6) AS BIGINT), 0) AS v{i}" for i, (c, u) in enumerate(_UNITS.items())]
                        + [f"CAST(({_DIAG_NOTNA}) * 100 AS BIGINT) AS v{len(_UNITS)}"])
_V = [f"v{i}" for i in range(len(_UNITS) + 1)]
_POINT = ", ".join(_V)
_POWER = " + ".join(f"(a.{v} - b.{v}) * (a.{v} - b.{v})" for v in _V)

_PURITY_SQL = with_ctes(
    CLAIMS_NT, CURRENCY,
    f"pts AS (SELECT {_VECTOR_SQL}, CAST(status = '{C.POSITIVE_CLASS}' AS BIGINT) AS y FROM cur)",
    f"mg AS (SELECT {_POINT}, count(*) AS m, sum(coalesce(y, 0)) AS c, row_number() OVER () AS id FROM pts GROUP BY {_POINT})",
    f"lim AS (SELECT a.id, list_max(min({_POWER}, {K + 1})) AS t FROM mg a, mg b WHERE a.c > 0 GROUP BY a.id)",
    f"lv AS (SELECT a.id, any_value(a.c) AS own, {_POWER} AS d, sum(b.m) - CASE WHEN {_POWER} = 0 THEN 1 ELSE 0 END AS m, "
    f"sum(b.c) - CASE WHEN {_POWER} = 0 THEN 1 ELSE 0 END AS c "
    f"FROM mg a JOIN lim USING (id), mg b WHERE {_POWER} <= lim.t GROUP BY a.id, {_POWER})",
    "cum AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lv)",
    f"sh AS (SELECT id, any_value(own) AS own, sum(least(m, {K} - b) * c / m) / sum(least(m, {K} - b)) AS share "
    f"FROM cum WHERE m > 0 AND b < {K} GROUP BY id)",
    "base AS (SELECT count(*) AS n_rows, CAST(coalesce(sum(y), 0) AS BIGINT) AS n_minority FROM pts)")


@query("x4_neighbour_purity", _PURITY_SQL(
    f"SELECT n_rows, n_minority, {r6('n_minority / n_rows')} AS base_rate, {r6('p')} AS purity, {r6('p / (n_minority / n_rows)')} AS lift "
    "FROM base, (SELECT sum(share * own) / sum(own) AS p FROM sh)"))
def x4_neighbour_purity(spark, sf_dir):
    cur = CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False))
    fields = [F.coalesce(F.floor(F.col(c) * u + F.lit(1e-6)).cast("long"), F.lit(0).cast("long")) for c, u in _UNITS.items()]
    filled = sum((F.col(c).isNotNull().cast("long") for c in C.DIAGNOSTIC_COLUMNS), F.lit(0).cast("long"))
    points = cur.select(F.array(*fields, filled * 100).alias("vec"), (F.col("status") == C.POSITIVE_CLASS).cast("long").alias("minority"))
    return round_doubles(neighbour_purity(points))


@query("a12_masked_narratives", with_ctes(CLAIMS)(
    "SELECT count(*) AS n_rows, count_if(coalesce(contains(issueDesc, '*'), false))::BIGINT AS n_masked FROM claims"))
def a12_masked_narratives(spark, sf_dir):
    """Claims whose narrative holds a masking sign; the sign is looked for once per document, so that no text is shuffled."""
    raw = raw_claims(spark, sf_dir, with_text=False)
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select(
        F.col("doc_id").alias("__doc"), F.contains("text", F.lit("*")).alias("masked"))
    return raw.join(docs, raw["doc_key"] == docs["__doc"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce("masked", F.lit(False))).alias("n_masked"))


_RATIOS = ("fee_to_rrp_ratio", "balance_ratio")


@query("a10_ratios_clipped", with_ctes(CLAIMS_NT, CURRENCY)(
    f"SELECT status, count(*) AS n, " + ", ".join(f"{r6(f'avg(CASE WHEN {c} IS NOT NULL THEN least({c}, {c}_q99) END)')} AS {c}_mean, {r6(f'max(CASE WHEN {c} IS NOT NULL THEN least({c}, {c}_q99) END)')} AS {c}_max"
                                                  for c in _RATIOS)
    + f" FROM {_RATIO_SRC} JOIN (SELECT status, " + ", ".join(f"quantile_cont({c}, 0.99) AS {c}_q99" for c in _RATIOS)
    + f" FROM {_RATIO_SRC} GROUP BY status) USING (status) GROUP BY status"))
def a10_ratios_clipped(spark, sf_dir):
    cur = CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False)).where(F.col("rrp") > 0)
    ratios = cur.select("status", (F.col("excessFee") / F.col("rrp")).alias(_RATIOS[0]), (F.col("balanceRRP") / F.col("rrp")).alias(_RATIOS[1]))
    clipped = Q.clip_at_quantile(ratios, "status", _RATIOS)
    return round_doubles(clipped.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{n}") for c in _RATIOS for n, f in (("mean", F.avg), ("max", F.max))]))
