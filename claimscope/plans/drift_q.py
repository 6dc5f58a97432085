"""Drift queries: reference spec, batch PSI report, verdict, triage (M1-M9, SNK3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import drift as DR
from claimscope.operators.quantiles import linspace_quantiles
from claimscope.plans.common import feature_matrix, round_doubles
from claimscope.plans.registry import query, with_ctes
from claimscope.session import cut_lineage
from claimscope.plans.sql_claims import FEATURE_CTES, FEATURE_NAMES

FEATURES = list(FEATURE_NAMES) + [C.SCORE_FEATURE]
SCORE_SQL = ("CAST((claim_key * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.8 AS DOUBLE) "
             "+ CASE WHEN claim_key % 34 = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
CURRENT_RULE = "claim_key % 4 = 0"   # the live batch; the rest is the frozen training reference


def scored_matrix(spark, sf_dir):
    """The scored feature matrix, written to the shared checkpoint folder (reused by both sides)."""
    m, _ = feature_matrix(spark, sf_dir, keep=("claim_id", "claim_key"))
    return cut_lineage(m.withColumn(C.SCORE_FEATURE, F.expr(SCORE_SQL)))


def reference_and_batch(spark, sf_dir):
    m = scored_matrix(spark, sf_dir)
    return m.where(~F.expr(CURRENT_RULE)), m.where(F.expr(CURRENT_RULE))


# ------------------------------------------------------------------------------ DuckDB twin

def _long(src):
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, TRY_CAST({f} AS DOUBLE) AS value FROM {src}"
                              for f in FEATURES)


_QVALUES = ", ".join(f"({i}, CAST('{q!r}' AS DOUBLE))" for i, q in enumerate(linspace_quantiles(C.PSI_N_BINS)))
_PRESENT = "(" + ", ".join(f"'{f}'" for f in FEATURES if f not in C.PSI_IGNORE) + ")"

DRIFT_CTES = FEATURE_CTES + (
    f"ms AS (SELECT *, {SCORE_SQL} AS {C.SCORE_FEATURE} FROM matrix)",
    f"ref_src AS (SELECT * FROM ms WHERE NOT ({CURRENT_RULE}))",
    f"cur_src AS (SELECT * FROM ms WHERE {CURRENT_RULE})",
    f"ref_long AS (SELECT * FROM ({_long('ref_src')}) WHERE value IS NOT NULL AND NOT isnan(value))",
    "ref_vc AS (SELECT feature, value, count(*) AS n FROM ref_long GROUP BY feature, value)",
    "ref_stats AS (SELECT feature, count(*) AS n_distinct, sum(n) AS n_clean FROM ref_vc GROUP BY feature)",
    f"""ref_cum AS (
  SELECT v.*, s.n_clean AS NN,
    coalesce(sum(v.n) OVER (PARTITION BY v.feature ORDER BY v.value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_before
  FROM ref_vc v JOIN ref_stats s ON s.feature = v.feature WHERE s.n_distinct > {C.CATEGORICAL_MAX_CARDINALITY})""",
    f"qs AS (SELECT * FROM (VALUES {_QVALUES}) t(qi, q))",
    """qpos AS (SELECT f.feature, qs.qi, qs.q * CAST(f.NN - 1 AS DOUBLE) AS pp, f.NN
  FROM (SELECT DISTINCT feature, NN FROM ref_cum) f CROSS JOIN qs)""",
    """qedge AS (
  SELECT p.feature, p.qi, CASE WHEN p.pp - floor(p.pp) >= 0.5
      THEN hi.value - (hi.value - lo.value) * (CAST(1 AS DOUBLE) - (p.pp - floor(p.pp)))
      ELSE lo.value + (hi.value - lo.value) * (p.pp - floor(p.pp)) END AS edge
  FROM qpos p
  JOIN ref_cum lo ON lo.feature = p.feature AND lo.n_before <= floor(p.pp) AND floor(p.pp) < lo.n_before + lo.n
  JOIN ref_cum hi ON hi.feature = p.feature AND hi.n_before <= least(floor(p.pp) + 1, p.NN - 1)
                  AND least(floor(p.pp) + 1, p.NN - 1) < hi.n_before + hi.n)""",
    """ref_edges AS (
  SELECT feature, edges, edges[2:len(edges) - 1] AS inner_edges FROM (
    SELECT feature, list_sort(list_distinct(list(edge))) AS edges FROM qedge GROUP BY feature))""",
    """num_counts AS (
  SELECT v.feature, len(list_filter(e.inner_edges, lambda x: x <= v.value)) AS bin, sum(v.n) AS cnt
  FROM ref_vc v JOIN ref_edges e ON e.feature = v.feature GROUP BY 1, 2)""",
    """num_bins AS (
  SELECT feature, CAST(unnest(range(len(edges) - 1)) AS INTEGER) AS bin, inner_edges FROM ref_edges)""",
    f"""cat_bins AS (
  SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS bin, value, n AS cnt
  FROM ref_vc WHERE feature IN (SELECT feature FROM ref_stats WHERE n_distinct <= {C.CATEGORICAL_MAX_CARDINALITY}))""",
    """cat_values AS (SELECT feature, list(value ORDER BY value) AS vals FROM cat_bins GROUP BY feature)""",
    """spec AS (
  SELECT b.feature, b.bin, coalesce(c.cnt, 0) / s.n_clean AS share FROM num_bins b
  JOIN ref_stats s ON s.feature = b.feature LEFT JOIN num_counts c ON c.feature = b.feature AND c.bin = b.bin
  UNION ALL
  SELECT b.feature, b.bin, b.cnt / s.n_clean FROM cat_bins b JOIN ref_stats s ON s.feature = b.feature)""",
    f"cur_long AS (SELECT * FROM ({_long('cur_src')}) WHERE value IS NOT NULL AND NOT isnan(value) AND feature IN {_PRESENT})",
    """cur_counts AS (
  SELECT l.feature, CASE WHEN cv.vals IS NOT NULL THEN coalesce(list_position(cv.vals, l.value), 0) - 1
                         ELSE len(list_filter(e.inner_edges, lambda x: x <= l.value)) END AS bin, count(*) AS cnt
  FROM cur_long l LEFT JOIN ref_edges e ON e.feature = l.feature LEFT JOIN cat_values cv ON cv.feature = l.feature
  WHERE e.feature IS NOT NULL OR cv.feature IS NOT NULL GROUP BY 1, 2)""",
    "cur_clean AS (SELECT feature, sum(cnt) AS n_clean FROM cur_counts GROUP BY feature)",
    """psi_bins AS (
  SELECT s.feature, s.bin, s.share AS ref_share,
    coalesce(CASE WHEN cc.n_clean = 0 THEN NULL ELSE c.cnt / cc.n_clean END, CAST(0 AS DOUBLE)) AS cur_share,
    CAST(1 AS DOUBLE) / (2 * greatest((SELECT count(*) FROM cur_src), 1)) AS fl
  FROM spec s LEFT JOIN cur_counts c ON c.feature = s.feature AND c.bin = s.bin
  LEFT JOIN cur_clean cc ON cc.feature = s.feature
  WHERE s.feature IN """ + _PRESENT + ")",
    """psi_contrib AS (
  SELECT *, (greatest(cur_share, fl) - greatest(ref_share, fl)) * ln(greatest(cur_share, fl) / greatest(ref_share, fl)) AS contrib
  FROM psi_bins)""",
    f"""report AS (
  SELECT feature, psi, CASE WHEN psi >= {C.PSI_ALARM} THEN 'alarm' WHEN psi >= {C.PSI_WATCH} THEN 'watch' ELSE 'stable' END AS status,
    bin AS largest_shift_bin, ref_share AS reference_share, cur_share AS current_share FROM (
    SELECT *, sum(contrib) OVER (PARTITION BY feature) AS psi,
      row_number() OVER (PARTITION BY feature ORDER BY abs(contrib) DESC, bin ASC) AS rn FROM psi_contrib)
  WHERE rn = 1)""",
)


def r4(x):
    return f"floor(({x}) * 10000.0 + 0.5) / 10000.0"


_REPORT_SQL = with_ctes(*DRIFT_CTES)(
    f"SELECT feature, {r4('psi')} AS psi, status, largest_shift_bin, {r4('reference_share')} AS reference_share, "
    f"{r4('current_share')} AS current_share FROM report ORDER BY psi DESC, feature")


@query("m1_reference_bins", with_ctes(*DRIFT_CTES)(
    "SELECT feature, bin, floor(share * 1e6 + 0.5) / 1e6 AS share FROM spec"))
def m1_reference_bins(spark, sf_dir):
    ref, _ = reference_and_batch(spark, sf_dir)
    spec = DR.build_reference(ref, FEATURES)
    return round_doubles(spec.select("feature", "bin", "share"))


@query("m6_drift_report", _REPORT_SQL)
def m6_drift_report(spark, sf_dir):
    """M2-M6: PSI per feature (and the score) of the live batch against the frozen reference."""
    ref, cur = reference_and_batch(spark, sf_dir)
    spec = cut_lineage(DR.build_reference(ref, FEATURES))
    return DR.drift_report(spec, cur, FEATURES)


@query("m6_drift_summary", with_ctes(*DRIFT_CTES)(
    "SELECT CAST((SELECT count(*) FROM cur_src) AS BIGINT) AS n_rows, CAST(NULL AS VARCHAR) AS skipped, "
    f"count_if(feature <> '{C.SCORE_FEATURE}' AND status = 'alarm') AS n_alarms, "
    f"count_if(feature <> '{C.SCORE_FEATURE}' AND status = 'watch') AS n_watches, "
    "coalesce(bool_or(status = 'alarm'), false) AS requires_investigation FROM report"))
def m6_drift_summary(spark, sf_dir):
    ref, cur = reference_and_batch(spark, sf_dir)
    spec = cut_lineage(DR.build_reference(ref, FEATURES))
    return DR.drift_summary(DR.drift_report(spec, cur, FEATURES), cur.count())


@query("m8_drift_triage", with_ctes(*DRIFT_CTES)(
    f"SELECT features_alarm, score_alarm, CASE WHEN NOT features_alarm AND NOT score_alarm THEN 'none' "
    "WHEN features_alarm AND NOT score_alarm THEN 'investigate source data' "
    "WHEN NOT features_alarm AND score_alarm THEN 'check for model regression' ELSE 'retrain candidate' END AS action "
    f"FROM (SELECT coalesce(bool_or(feature <> '{C.SCORE_FEATURE}' AND status = 'alarm'), false) AS features_alarm, "
    f"coalesce(bool_or(feature = '{C.SCORE_FEATURE}' AND status = 'alarm'), false) AS score_alarm FROM report)"))
def m8_drift_triage(spark, sf_dir):
    ref, cur = reference_and_batch(spark, sf_dir)
    spec = cut_lineage(DR.build_reference(ref, FEATURES))
    rep = DR.drift_report(spec, cur, FEATURES)
    flags = rep.agg(
        F.coalesce(F.bool_or((F.col("feature") != C.SCORE_FEATURE) & (F.col("status") == "alarm")),
                   F.lit(False)).alias("features_alarm"),
        F.coalesce(F.bool_or((F.col("feature") == C.SCORE_FEATURE) & (F.col("status") == "alarm")),
                   F.lit(False)).alias("score_alarm"))
    return DR.triage(flags)
