"""Evaluation queries over deterministic candidate scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import evaluate as EV
from claimscope.plans.common import persisted, round_doubles
from claimscope.plans.registry import query, with_ctes
from claimscope.plans.sql_claims import r6
from claimscope.sources.claims import claims_sql, raw_claims

_HASH = ("CAST((k * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.8 AS DOUBLE) "
         "+ CASE WHEN y = 1 AND k % 2 = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
_RULE = ("CAST(0.1 AS DOUBLE) + CASE WHEN claimType = 'Theft' THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
         "+ CASE WHEN policyStatus = 'Grace Period' THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
         "+ CASE WHEN coverage = 'ADLD/THEFT' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
         "+ CASE WHEN touchScreen IS NULL THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")

# Candidate scorers: deterministic stand-ins for model outputs, so every metric is oracle-checkable.
CANDIDATES = {
    "hash_score": _HASH,
    "hash_score_sq": f"({_HASH}) * ({_HASH})",
    "rule_score": _RULE,
    "blend_score": f"(({_HASH}) + ({_RULE})) / CAST(2 AS DOUBLE)",
}
FLAGSHIP = "hash_score"
WEIGHTS = {  # FIXED VALUES: criterion -> (weight, direction)
    "f1_declined": (0.35, "max"),
    "recall_declined": (0.20, "max"),
    "brier": (0.15, "min"),
    "shap_quality": (0.15, "max"),
    "f1_std": (0.10, "min"),
    "native_missing": (0.05, "max"),
}
PANELS = {"recall_declined": "max", "precision_declined": "max", "pr_auc": "max", "brier": "min"}

# ------------------------------------------------------------------------------ Spark side


def labelled_claims(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False)
    y = (F.col("status") == C.POSITIVE_CLASS).cast("int")
    base = raw.select("claim_id", F.col("claim_key").alias("k"), y.alias("y"), "claimType",
                      "policyStatus", "coverage", "touchScreen", "country", "channel", "deviceType", "rrp")
    return EV.stratified_folds(base, "y", "claim_id")


def scored_long(spark, sf_dir):
    """(claim_id, k, y, fold, model, p): every candidate's score for every claim."""
    lab = labelled_claims(spark, sf_dir)
    wide = lab.selectExpr("claim_id", "k", "y", "fold", "country", "channel", "deviceType",
                          *[f"{e} AS {m}" for m, e in CANDIDATES.items()])
    return wide.unpivot(["claim_id", "k", "y", "fold", "country", "channel", "deviceType"],
                        list(CANDIDATES), "model", "p")


def flagship_scores(spark, sf_dir):
    return scored_long(spark, sf_dir).where(F.col("model") == FLAGSHIP)


def _fold_metrics(spark, sf_dir):
    return EV.fold_metrics(persisted(scored_long(spark, sf_dir)))


def _summary(spark, sf_dir):
    return EV.cv_summary(_fold_metrics(spark, sf_dir))


def _with_criteria(summary):
    return summary.withColumns({"shap_quality": F.lit(1.0), "native_missing": F.lit(0.0)})


# ------------------------------------------------------------------------------ DuckDB side

CLAIMS_NT = claims_sql(with_text=False)
LABELS = ("labels AS (SELECT claim_id, claim_key AS k, CASE WHEN status = 'Declined' THEN 1 ELSE 0 END AS y, "
          "claimType, policyStatus, coverage, touchScreen, country, channel, deviceType, rrp FROM claims)")
FOLDED = ("folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(claim_id AS VARCHAR) "
          f"|| '|{C.RANDOM_STATE}'), claim_id) - 1) % {C.N_FOLDS} AS INTEGER) AS fold FROM labels)")
SCORED = "scored AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT claim_id, k, y, fold, country, channel, deviceType, '{m}' AS model, {e} AS p FROM folded"
    for m, e in CANDIDATES.items()) + "\n)"
BASE = (CLAIMS_NT, LABELS, FOLDED, SCORED)

G0, GS, NG = C.THRESHOLD_RANGE[0], C.THRESHOLD_STEP, EV.N_GRID


def _gv(i):
    return f"(CAST({G0} AS DOUBLE) + CAST({i} AS DOUBLE) * CAST({GS} AS DOUBLE))"


_EST = f"least(greatest(CAST(floor((p - CAST({G0} AS DOUBLE)) / CAST({GS} AS DOUBLE)) AS BIGINT) + 1, 0), {NG})"
GRIDC = ("gridc AS (SELECT *, CASE WHEN up > 0 AND " + _gv("up - 1") + " > p THEN up - 1 ELSE up END AS c FROM "
         "(SELECT *, CASE WHEN est < " + str(NG) + " AND " + _gv("est") + " <= p THEN est + 1 ELSE est END AS up FROM "
         f"(SELECT *, {_EST} AS est FROM scored)))")

FOLD_CELLS = """fold_cells AS (SELECT model, fold, c, sum(y) AS pos, sum(1 - y) AS neg FROM gridc GROUP BY model, fold, c),
tot_cells AS (SELECT model, c, sum(pos) AS tpos, sum(neg) AS tneg FROM fold_cells GROUP BY model, c),
fold_ids AS (SELECT DISTINCT model, fold FROM fold_cells),
train_cells AS (
  SELECT t.model, f.fold, t.c, t.tpos - coalesce(fc.pos, 0) AS pos, t.tneg - coalesce(fc.neg, 0) AS neg
  FROM tot_cells t JOIN fold_ids f ON f.model = t.model
  LEFT JOIN fold_cells fc ON fc.model = t.model AND fc.fold = f.fold AND fc.c = t.c)"""


def _best_sql(name, cells, keys, metric="f1"):
    k = ", ".join(keys)
    val = ("CASE WHEN 2 * S_pos + S_neg + (n_pos - S_pos) = 0 THEN CAST(0 AS DOUBLE) ELSE 2 * S_pos / "
           "CAST(2 * S_pos + S_neg + (n_pos - S_pos) AS DOUBLE) END") if metric == "f1" else \
        "CASE WHEN n_pos = 0 THEN CAST(0 AS DOUBLE) ELSE S_pos / CAST(n_pos AS DOUBLE) END"
    return f"""{name} AS (
  SELECT {k}, {_gv('i')} AS threshold, value FROM (
    SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY value DESC, i ASC) AS rn FROM (
      SELECT *, {val} AS value,
        coalesce(lag(c) OVER (PARTITION BY {k} ORDER BY c), 0) AS i
      FROM (SELECT {k}, c, sum(pos) OVER (PARTITION BY {k}) AS n_pos,
              sum(pos) OVER (PARTITION BY {k} ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS S_pos,
              sum(neg) OVER (PARTITION BY {k} ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS S_neg
            FROM {cells}) WHERE c >= 1)) WHERE rn = 1)"""


def _safe(a, b):
    return f"CASE WHEN ({b}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _ranking_sql(name, keys):
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT {k}, {_safe('sum(pos * (neg_before + CAST(0.5 AS DOUBLE) * neg))', 'CAST(max(n_pos) AS DOUBLE) * max(n_neg)')} AS roc_auc,
    {_safe('sum(pos * ' + _safe('n_pos - pos_before', 'n_pos - pos_before + n_neg - neg_before') + ')', 'max(n_pos)')} AS pr_auc
  FROM (SELECT *, sum(pos) OVER (PARTITION BY {k}) AS n_pos, sum(neg) OVER (PARTITION BY {k}) AS n_neg,
          coalesce(sum(pos) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
          coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
        FROM (SELECT {k}, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
              FROM scored GROUP BY {k}, p))
  GROUP BY {k})"""


FOLD_TH = _best_sql("fold_th", "train_cells", ["model", "fold"])
CONF = f"""conf AS (
  SELECT s.model, s.fold, max(t.threshold) AS threshold,
    count_if(s.p < t.threshold AND s.y = 0) AS true_negatives,
    count_if(s.p >= t.threshold AND s.y = 0) AS false_positives,
    count_if(s.p < t.threshold AND s.y = 1) AS false_negatives,
    count_if(s.p >= t.threshold AND s.y = 1) AS true_positives,
    count(*) AS n_val, CAST(sum(s.y) AS BIGINT) AS n_declined, avg((s.p - s.y) * (s.p - s.y)) AS brier
  FROM scored s JOIN fold_th t ON t.model = s.model AND t.fold = s.fold GROUP BY s.model, s.fold)"""
FOLD_RANK = _ranking_sql("fold_rank", ["model", "fold"])
FOLDS = f"""folds AS (
  SELECT c.*, {_safe('true_positives', 'true_positives + false_positives')} AS precision_declined,
    {_safe('true_positives', 'true_positives + false_negatives')} AS recall_declined,
    {_safe('2 * true_positives', '2 * true_positives + false_positives + false_negatives')} AS f1_declined,
    r.roc_auc, r.pr_auc
  FROM conf c JOIN fold_rank r ON r.model = c.model AND r.fold = c.fold)"""
FOLD_CTES = BASE + (GRIDC, FOLD_CELLS, FOLD_TH, CONF, FOLD_RANK, FOLDS)


def rN(x, d):
    s = float(10 ** d)
    return f"floor(({x}) * {s} + 0.5) / {s}"


SUMMARY = "summary AS (SELECT model, " + ", ".join(
    f"{rN(f'avg({m})', 4)} AS {m}" for m in EV.METRICS) + ", " + \
    f"{rN('stddev_pop(f1_declined)', 4)} AS f1_std, {rN('avg(threshold)', 3)} AS threshold, " \
    f"{rN('stddev_pop(threshold)', 3)} AS threshold_std FROM folds GROUP BY model)"
SUMMARY_CTES = FOLD_CTES + (SUMMARY,)
SUMMARY_COLS = ("model",) + EV.METRICS + ("f1_std", "threshold", "threshold_std")


def _weighted_sql():
    terms = []
    for col, (w, d) in WEIGHTS.items():
        v = f"CAST({col} AS DOUBLE)"
        lo, hi = f"min({v}) OVER ()", f"max({v}) OVER ()"
        norm = (f"CASE WHEN {hi} = {lo} THEN CAST(1 AS DOUBLE) ELSE "
                + (f"({v} - {lo}) / ({hi} - {lo})" if d == "max" else f"({hi} - {v}) / ({hi} - {lo})") + " END")
        terms.append(f"({norm}) * CAST({w} AS DOUBLE)")
    score = rN("CAST(0 AS DOUBLE) + " + " + ".join(terms), 4)
    return ("weighted AS (SELECT *, row_number() OVER (ORDER BY weighted_score DESC, model) AS rank FROM ("
            f"SELECT *, {score} AS weighted_score FROM (SELECT *, CAST(1 AS DOUBLE) AS shap_quality, "
            "CAST(0 AS DOUBLE) AS native_missing FROM summary)))")


WEIGHTED = _weighted_sql()

# ------------------------------------------------------------------------------ queries


@query("w3_stratified_folds", with_ctes(*BASE[:3])("SELECT claim_id, y, fold FROM folded"))
def w3_stratified_folds(spark, sf_dir):
    return labelled_claims(spark, sf_dir).select("claim_id", "y", "fold")


@query("a17_best_threshold", with_ctes(*BASE, GRIDC, "all_cells AS (SELECT model, c, sum(y) AS pos, sum(1 - y) AS neg FROM gridc GROUP BY model, c)",
                                       _best_sql("b_f1", "all_cells", ["model"], "f1"),
                                       _best_sql("b_rec", "all_cells", ["model"], "recall"))(
    f"SELECT model, 'f1_declined' AS metric, {r6('threshold')} AS threshold, {r6('value')} AS value FROM b_f1 "
    f"UNION ALL SELECT model, 'recall_declined', {r6('threshold')}, {r6('value')} FROM b_rec"))
def a17_best_threshold(spark, sf_dir):
    cells = EV.grid_counts(persisted(scored_long(spark, sf_dir)), ["model"])
    f1 = EV.best_threshold(cells, ["model"], "f1_declined").select(
        "model", F.lit("f1_declined").alias("metric"), "threshold", F.col("f1_declined").alias("value"))
    rec = EV.best_threshold(cells, ["model"], "recall_declined").select(
        "model", F.lit("recall_declined").alias("metric"), "threshold", F.col("recall_declined").alias("value"))
    return round_doubles(f1.unionByName(rec))


FOLD_COLS = ("model", "fold", "threshold", "true_negatives", "false_positives", "false_negatives",
             "true_positives", "n_val", "n_declined", "brier", "precision_declined", "recall_declined",
             "f1_declined", "roc_auc", "pr_auc")


def _cols_sql(cols, doubles):
    return ", ".join(r6(c) + f" AS {c}" if c in doubles else c for c in cols)


_FOLD_DOUBLES = {"threshold", "brier", "precision_declined", "recall_declined", "f1_declined", "roc_auc", "pr_auc"}


@query("a13_fold_metrics", with_ctes(*FOLD_CTES)(f"SELECT {_cols_sql(FOLD_COLS, _FOLD_DOUBLES)} FROM folds"))
def a13_fold_metrics(spark, sf_dir):
    """A13-A16 per fold, threshold chosen on the training part (the X5 protocol on given scores)."""
    return round_doubles(_fold_metrics(spark, sf_dir).select(*FOLD_COLS))


@query("a14_a16_ranking_metrics", with_ctes(*BASE, _ranking_sql("rk", ["model"]))(
    f"SELECT r.model, {r6('roc_auc')} AS roc_auc, {r6('pr_auc')} AS pr_auc, {r6('b.brier')} AS brier FROM rk r "
    "JOIN (SELECT model, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY model) b ON b.model = r.model"))
def a14_a16_ranking_metrics(spark, sf_dir):
    s = persisted(scored_long(spark, sf_dir))
    brier = s.groupBy("model").agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    return round_doubles(EV.ranking_metrics(s, ["model"]).join(brier, "model"))


@query("a18_cv_summary", with_ctes(*SUMMARY_CTES)("SELECT * FROM summary"))
def a18_cv_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select(*SUMMARY_COLS)


@query("o1_comparison_frame", with_ctes(*SUMMARY_CTES)("SELECT * FROM summary ORDER BY f1_declined DESC, model"))
def o1_comparison_frame(spark, sf_dir):
    return EV.comparison_frame(_summary(spark, sf_dir).select(*SUMMARY_COLS))


@query("o2_top_candidates", with_ctes(*SUMMARY_CTES)("SELECT * FROM summary ORDER BY f1_declined DESC, model LIMIT 3"))
def o2_top_candidates(spark, sf_dir):
    return EV.top_candidates(_summary(spark, sf_dir).select(*SUMMARY_COLS))


@query("a19_baseline_metrics", with_ctes(*BASE[:2])(
    f"SELECT {r6('1 - avg(y)')} AS accuracy, CAST(0 AS DOUBLE) AS f1_declined, CAST(0 AS DOUBLE) AS recall_declined FROM labels"))
def a19_baseline_metrics(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False)
    y = (F.col("status") == C.POSITIVE_CLASS).cast("int").alias("y")
    return round_doubles(EV.baseline_metrics(raw.select(y)))


_CM = ("true_negatives", "false_positives", "false_negatives", "true_positives")


@query("a20_pooled_confusion", with_ctes(*FOLD_CTES)(
    "SELECT model, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _CM) + ", "
    + r6(_safe("sum(true_negatives) + sum(true_positives)", " + ".join(f"sum({c})" for c in _CM))) + " AS accuracy, "
    + r6(_safe("sum(true_negatives) + sum(false_positives)", " + ".join(f"sum({c})" for c in _CM)))
    + " AS constant_accuracy FROM folds GROUP BY model"))
def a20_pooled_confusion(spark, sf_dir):
    return round_doubles(EV.pooled_confusion(_fold_metrics(spark, sf_dir)))


@query("a21_decile_lift", with_ctes(*BASE)(
    "SELECT model, decile, count(*) AS n, CAST(sum(y) AS BIGINT) AS declines, " + r6("avg(y)") + " AS rate, "
    + r6("avg(y) / max(base_rate)") + " AS lift FROM ("
    "SELECT s.*, len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < s.p)) AS decile, e.base_rate FROM scored s "
    "JOIN (SELECT model, list_sort(list_distinct(quantile_cont(p, [" + ", ".join(str(i / 10) for i in range(11))
    + "]))) AS edges, avg(y) AS base_rate FROM scored GROUP BY model) e ON e.model = s.model) GROUP BY model, decile"))
def a21_decile_lift(spark, sf_dir):
    return round_doubles(EV.decile_lift(persisted(scored_long(spark, sf_dir)), ["model"]))


@query("a22_calibration_curve", with_ctes(*BASE)(
    "SELECT model, bin, count(*) AS n, " + r6("avg(p)") + " AS mean_predicted, " + r6("avg(y)") + " AS observed_rate FROM ("
    "SELECT s.*, len(list_filter(e.edges[2:10], lambda x: x < s.p)) AS bin FROM scored s "
    "JOIN (SELECT model, quantile_cont(p, [" + ", ".join(str(i / 10) for i in range(11))
    + "]) AS edges FROM scored GROUP BY model) e ON e.model = s.model) GROUP BY model, bin"))
def a22_calibration_curve(spark, sf_dir):
    return round_doubles(EV.calibration_curve(persisted(scored_long(spark, sf_dir)), ["model"]))


_BAND = ("CASE WHEN p <= CAST(0.3 AS DOUBLE) THEN 'low' WHEN p <= CAST(0.7 AS DOUBLE) THEN 'mid' ELSE 'high' END")
_A23_SQL = with_ctes(*BASE)(
    "SELECT model, band, claims, declines, " + r6("decline_rate") + " AS decline_rate, " + r6("score_min")
    + " AS score_min, " + r6("score_median") + " AS score_median, " + r6("score_max") + " AS score_max, "
    + r6("claims / sum(claims) OVER (PARTITION BY model)") + " AS share_volume, "
    + r6(_safe("declines", "sum(declines) OVER (PARTITION BY model)")) + " AS share_declines FROM ("
    f"SELECT model, {_BAND} AS band, count(*) AS claims, CAST(sum(y) AS BIGINT) AS declines, avg(y) AS decline_rate, "
    "min(p) AS score_min, quantile_cont(p, 0.5) AS score_median, max(p) AS score_max FROM scored "
    f"WHERE model = '{FLAGSHIP}' GROUP BY model, band)")


@query("a23_routing_bands", _A23_SQL)
def a23_routing_bands(spark, sf_dir):
    """Flagship: volume, decline rate and share of declines per human-review band."""
    return round_doubles(EV.routing_bands(flagship_scores(spark, sf_dir), ["model"]))


@query("a24_weighted_decision", with_ctes(*SUMMARY_CTES, WEIGHTED)(
    "SELECT model, f1_declined, recall_declined, brier, f1_std, native_missing, weighted_score, rank FROM weighted"))
def a24_weighted_decision(spark, sf_dir):
    w = EV.weighted_decision(_with_criteria(_summary(spark, sf_dir)), WEIGHTS)
    return w.select("model", "f1_declined", "recall_declined", "brier", "f1_std", "native_missing",
                    "weighted_score", "rank")


@query("x8_champion", with_ctes(*SUMMARY_CTES, WEIGHTED)(
    "SELECT model, weighted_score FROM weighted WHERE rank = 1"))
def x8_champion(spark, sf_dir):
    w = EV.weighted_decision(_with_criteria(_summary(spark, sf_dir)), WEIGHTS)
    return w.where(F.col("rank") == 1).select("model", "weighted_score")


def _o5_sql():
    parts = []
    for m, d in PANELS.items():
        sgn = "" if d == "max" else "-"
        parts.append(f"SELECT '{m}' AS metric, arg_max(model, ({sgn}CAST({m} AS DOUBLE), model)) AS best, "
                     f"arg_min(model, ({sgn}CAST({m} AS DOUBLE), model)) AS worst FROM summary")
    return with_ctes(*SUMMARY_CTES)(" UNION ALL ".join(parts))


@query("o5_best_and_worst", _o5_sql())
def o5_best_and_worst(spark, sf_dir):
    return EV.best_and_worst(_summary(spark, sf_dir), PANELS)


@query("o6_seeded_sample", with_ctes(CLAIMS_NT)(
    f"SELECT claim_id, status FROM claims ORDER BY md5(claim_id || '|{C.RANDOM_STATE}') LIMIT {C.SAMPLE_ROWS}"))
def o6_seeded_sample(spark, sf_dir):
    return EV.seeded_sample(raw_claims(spark, sf_dir, with_text=False).select("claim_id", "status"), "claim_id")


# Fairness at the flagship's best-F1 threshold, per country / channel / device (GROUPING SETS).
_A26_SQL = with_ctes(*BASE, GRIDC, "all_cells AS (SELECT model, c, sum(y) AS pos, sum(1 - y) AS neg FROM gridc GROUP BY model, c)",
                     _best_sql("b_f1", "all_cells", ["model"], "f1"))(
    "SELECT dimension, level, n, " + r6("f1") + " AS f1_declined, " + r6("fdr") + " AS false_decline_rate, "
    "(max(f1) OVER (PARTITION BY dimension) - min(f1) OVER (PARTITION BY dimension)) > 0.05 AS spread_flag FROM ("
    "SELECT CASE WHEN GROUPING(country) = 0 THEN 'country' WHEN GROUPING(channel) = 0 THEN 'channel' ELSE 'deviceType' END AS dimension, "
    "coalesce(country, channel, deviceType, 'nan') AS level, count(*) AS n, "
    + _safe("2 * count_if(pred = 1 AND y = 1)", "2 * count_if(pred = 1 AND y = 1) + count_if(pred = 1 AND y = 0) + count_if(pred = 0 AND y = 1)")
    + " AS f1, " + _safe("count_if(pred = 1 AND y = 0)", "count_if(y = 0)") + " AS fdr FROM ("
    f"SELECT s.*, CAST(s.p >= t.threshold AS INTEGER) AS pred FROM scored s JOIN b_f1 t ON t.model = s.model WHERE s.model = '{FLAGSHIP}') "
    "GROUP BY GROUPING SETS ((country), (channel), (deviceType)))")


@query("a26_group_fairness", _A26_SQL)
def a26_group_fairness(spark, sf_dir):
    from claimscope.operators.fairness import group_fairness
    s = persisted(flagship_scores(spark, sf_dir))
    th = EV.best_threshold(EV.grid_counts(s, ["model"]), ["model"]).select("model", "threshold")
    return round_doubles(group_fairness(s.join(F.broadcast(th), "model"), ("country", "channel", "deviceType")))


_A27 = ("claimType", "policyStatus", "deviceType")


@query("a27_subgroup_evidence", with_ctes(CLAIMS_NT)(
    "SELECT CASE WHEN GROUPING(claimType) = 0 THEN 'claimType' WHEN GROUPING(policyStatus) = 0 THEN 'policyStatus' "
    "ELSE 'deviceType' END AS dimension, coalesce(claimType, policyStatus, deviceType, 'nan') AS level, "
    "count(*) AS n, " + r6("avg(CASE WHEN status = 'Declined' THEN 1 ELSE 0 END)") + " AS decline_rate "
    "FROM claims GROUP BY GROUPING SETS ((claimType), (policyStatus), (deviceType))"))
def a27_subgroup_evidence(spark, sf_dir):
    from claimscope.operators.fairness import subgroup_evidence
    return round_doubles(subgroup_evidence(raw_claims(spark, sf_dir, with_text=False), _A27))
