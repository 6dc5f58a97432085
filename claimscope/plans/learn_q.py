"""Learning, scoring, attribution and registry queries (X1-X12, A25, W1-W2, D6, J2-J3, SNK4-SNK7, O3-O4).

These run real Spark ML fits, so most are rows-only checks backed by unit tests
(additivity, fold coverage); the label joins are oracle-checked.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import attribution as AT
from claimscope.operators import decide as DE
from claimscope.operators import evaluate as EV
from claimscope.operators import learn as LN
from claimscope.operators import oversample as OV
from claimscope.operators import search as SE
from claimscope.plans import eval_q as EQ
from claimscope.plans.common import feature_matrix, persisted
from claimscope.plans.registry import query, with_ctes
from claimscope.plans.sql_claims import FEATURE_CTES, FEATURE_NAMES
from claimscope.session import cut_lineage, ensure_checkpoint_dir, r6

RF_PARAMS = {"numTrees": 20, "maxDepth": 5}


def fold_matrix(spark, sf_dir, nested: bool = False):
    """The stored feature matrix with its missing values, a stratified fold and (nested) the inner folds of each row."""
    m, enc = feature_matrix(spark, sf_dir, keep=("claim_id",))
    m = EV.stratified_folds(m, C.TARGET, "claim_id")
    if nested:
        m = LN.with_inner_folds(cut_lineage(m))
    return cut_lineage(m), list(enc.feature_names)


def training_matrix(spark, sf_dir):
    """Matrix with -1 sentinels for trees, balanced weights and a stratified fold column."""
    m, enc = feature_matrix(spark, sf_dir, keep=("claim_id",))
    feats = list(enc.feature_names)
    m = LN.with_class_weight(LN.forest_inputs(m, feats))
    m = EV.stratified_folds(m, C.TARGET, "claim_id")
    return cut_lineage(m), feats


def fitted_forest(spark, sf_dir):
    m, feats = training_matrix(spark, sf_dir)
    model = LN.build_model("random_forest", feats, RF_PARAMS).fit(m)
    return model, m, feats


@query("x2_batch_scores")
def x2_batch_scores(spark, sf_dir):
    """X1 + X2: fit the forest candidate and score every claim (P(Declined))."""
    model, m, _ = fitted_forest(spark, sf_dir)
    return LN.score(model, m).select("claim_id", "score")


def shap_tables(spark, sf_dir):
    model, m, feats = fitted_forest(spark, sf_dir)
    return model, m, feats, AT.explain(spark, model, m, feats)


@query("x9_tree_shap")
def x9_tree_shap(spark, sf_dir):
    """Per-claim, per-feature exact TreeSHAP contributions with direction."""
    _, m, feats, wide = shap_tables(spark, sf_dir)
    return AT.long_contributions(wide, feats)


@query("x11_shap_additivity", with_ctes(EQ.CLAIMS_NT)(
    "SELECT count(*) AS n_claims, CAST(0 AS BIGINT) AS violations, CAST(0 AS DOUBLE) AS max_abs_error FROM claims"))
def x11_shap_additivity(spark, sf_dir):
    """X11: base + sum(shap) against the forest's own probability; violations must be 0, the greatest error 0 at six decimals."""
    model, m, _, wide = shap_tables(spark, sf_dir)
    s = LN.score(model, m).select("claim_id", "score")
    j = wide.select("claim_id", "reconstructed").join(s, "claim_id")
    return j.agg(F.count(F.lit(1)).alias("n_claims"),
                 F.count_if(F.abs(F.col("reconstructed") - F.col("score")) > 1e-6).alias("violations"),
                 r6(F.max(F.abs(F.col("reconstructed") - F.col("score")))).alias("max_abs_error"))


@query("a25_global_importance")
def a25_global_importance(spark, sf_dir):
    _, m, feats, wide = shap_tables(spark, sf_dir)
    return AT.global_importance(AT.long_contributions(wide, feats))


@query("w1_w2_d6_persona_factors")
def w1_w2_d6_persona_factors(spark, sf_dir):
    """W1 top-n (technical personas), W2 3 up / 2 down (customer), labelled (J2) and projected."""
    _, m, feats, wide = shap_tables(spark, sf_dir)
    wide = persisted(wide)
    outs = []
    # a row's own strongest factors are all that a persona can be shown of it: only they are exploded and ranked
    few = lambda positions: AT.with_labels(AT.long_contributions(wide, feats, positions=positions), AT.label_table(spark))
    for p, cfg in C.PERSONAS.items():
        if cfg["show_shap_values"]:
            top = DE.top_contributions(few(AT.strongest(len(feats), cfg["top_n"])).withColumn("top_n", F.lit(cfg["top_n"])))
            outs.append(AT.as_dict(top, plain=False).select("claim_id", F.lit(p).alias("persona"),
                                                            F.to_json("factor").alias("factor")))
        else:
            bal = DE.directional(few(AT.both_sides(len(feats))))
            outs.append(AT.as_dict(bal, plain=True).select("claim_id", F.lit(p).alias("persona"),
                                                           F.to_json("factor").alias("factor")))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("x5_x6_forest_cross_validation")
def x5_x6_forest_cross_validation(spark, sf_dir):
    """Nested cross-validation of the forest: out-of-fold scores, thresholds from inner folds, per-fold metrics."""
    m, feats = fold_matrix(spark, sf_dir, nested=True)
    oof, inner = LN.nested_scores(m, "random_forest", feats, RF_PARAMS)
    return LN.nested_metrics(oof, inner)


_INNER_SQL = ("nested AS (SELECT f.claim_id, f.y, f.fold AS own, o.o AS fold, CAST((row_number() OVER (PARTITION BY o.o, f.y ORDER BY "
              f"md5(CAST(f.claim_id AS VARCHAR) || '|{C.RANDOM_STATE + 1}'), f.claim_id) - 1) % {C.INNER_FOLDS} AS INTEGER) AS inner_fold "
              f"FROM folded f, (SELECT unnest(range({C.N_FOLDS})) AS o) o WHERE o.o <> f.fold)")


@query("x5_nested_protocol", with_ctes(EQ.CLAIMS_NT, EQ.LABELS, EQ.FOLDED, _INNER_SQL)(
    "SELECT CAST(fold AS INTEGER) AS fold, inner_fold, count(*) AS n_scored, CAST(sum(y) AS BIGINT) AS n_declined, "
    "CAST(0 AS BIGINT) AS n_of_the_fold, CAST(0 AS BIGINT) AS n_invalid FROM nested GROUP BY fold, inner_fold "
    "UNION ALL SELECT fold, -1, count(*), CAST(sum(y) AS BIGINT), count(*), CAST(0 AS BIGINT) FROM folded GROUP BY fold"))
def x5_nested_protocol(spark, sf_dir):
    """Which claims chose each fold's threshold (one row per fold and inner fold; -1: the fold's own validation scores).

    Counted on the scores of a real run (logistic regression: imputation and scaling inside every training part):
    ``n_of_the_fold`` must be 0 for inner rows, ``n_invalid`` counts scores outside [0, 1].
    """
    m, feats = fold_matrix(spark, sf_dir, nested=True)
    oof, inner = LN.nested_scores(m, "logistic_regression", feats, {"maxIter": 5})
    rows = inner.select("claim_id", "fold", F.col("inner").alias("inner_fold"), "y", "p").unionByName(
        oof.select("claim_id", "fold", F.lit(-1).alias("inner_fold"), "y", "p"))
    own = m.select("claim_id", F.col("fold").alias("own"))
    return rows.join(own, "claim_id").groupBy("fold", "inner_fold").agg(
        F.count(F.lit(1)).alias("n_scored"), F.sum("y").cast("long").alias("n_declined"),
        F.count_if(F.col("own") == F.col("fold")).alias("n_of_the_fold"),
        F.count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("n_invalid"))


@query("x3_oversampling", with_ctes(EQ.CLAIMS_NT, EQ.LABELS, EQ.FOLDED)(
    "SELECT y, n AS n_real, max(n) OVER () - n AS n_synthetic, CAST(0 AS BIGINT) AS n_off_segment, CAST(0 AS BIGINT) AS n_of_another_class "
    "FROM (SELECT y, count(*) AS n FROM folded WHERE fold <> 0 GROUP BY y)"))
def x3_oversampling(spark, sf_dir):
    """The training part of fold 0, imputed and scaled, and its synthetic rows: classes equal in number, every synthetic row between two
    rows of its own class and of the training part."""
    m, feats = fold_matrix(spark, sf_dir)
    train = m.where("fold <> 0")
    pre = Pipeline(stages=LN.build_model("mlp", feats, imputed=LN.missing_columns(train, feats)).getStages()[:-1]).fit(train)
    ready = cut_lineage(pre.transform(train).select("claim_id", C.TARGET, vector_to_array("features").alias("vector")))
    made = OV.oversample(ready)                                  # read once, so not stored
    # the same columns for both ends, so that one shuffle of them serves both joins; the rows made are dealt by ``other`` already
    ends = ready.select(F.col("claim_id").alias("__id"), F.col("vector").alias("__vector"), F.col(C.TARGET).alias("__y"))

    def with_end(df, of, p):
        return df.join(ends, F.col(of) == F.col("__id"), "left").withColumnsRenamed({"__vector": f"{p}_vector", "__y": f"{p}_y"}).drop("__id")

    both = with_end(with_end(made, "other", "b"), "claim_id", "a")
    off = F.exists(F.arrays_zip(F.col("vector").alias("v"), F.col("a_vector").alias("a"), F.coalesce("b_vector", "a_vector").alias("b")),
                   lambda z: F.abs(z["v"] - (z["a"] + F.col("gap") * (z["b"] - z["a"]))) > 1e-9)
    on_line = F.col("gap").between(0, 1) & ~off
    checked = both.groupBy(F.col(C.TARGET).alias("y")).agg(
        F.count(F.lit(1)).alias("n_synthetic"), F.count_if(~F.coalesce(on_line, F.lit(False))).alias("n_off_segment"),
        F.count_if((F.col("a_y") != F.col(C.TARGET)) | (F.coalesce("b_y", "a_y") != F.col(C.TARGET))).alias("n_of_another_class"))
    real = ready.groupBy(F.col(C.TARGET).alias("y")).agg(F.count(F.lit(1)).alias("n_real"))
    return real.join(checked, "y", "left").select("y", "n_real", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (
        "n_synthetic", "n_off_segment", "n_of_another_class")])


def _family_query(name: str, params: dict):
    @query(f"x1_{name}", with_ctes(EQ.CLAIMS_NT, EQ.LABELS, EQ.FOLDED)(
        f"SELECT '{name}' AS model, count(*) AS n_scored, CAST(sum(y) AS BIGINT) AS n_declined, CAST(0 AS BIGINT) AS n_invalid, "
        "true AS ranks_better_than_chance FROM folded WHERE fold = 0"))
    def run(spark, sf_dir):
        m, feats = fold_matrix(spark, sf_dir)
        imputed = None if name in LN.TREE_FAMILIES else LN.missing_columns(m, feats)
        model = LN.fit(name, m.where("fold <> 0"), feats, params, imputed=imputed)
        s = LN.score(model, LN.family_inputs(m.where("fold = 0"), name, feats)).select(
            F.lit(name).alias("model"), F.col(C.TARGET).alias("y"), F.col("score").alias("p"))
        s = cut_lineage(s)
        auc = EV.ranking_metrics(s, ["model"]).select("model", (F.col("roc_auc") > 0.5).alias("ranks_better_than_chance"))
        counts = s.groupBy("model").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("y").cast("long").alias("n_declined"),
                                        F.count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("n_invalid"))
        return counts.join(auc, "model")
    run.__name__ = f"x1_{name}"
    run.__doc__ = f"X1/F13: the {name} candidate, fitted on four folds (its imputation too), scores the fifth."
    return run


x1_logistic_regression = _family_query("logistic_regression", {"maxIter": 20})
x1_random_forest = _family_query("random_forest", RF_PARAMS)
x1_gbt = _family_query("gbt", {"maxIter": 10, "maxDepth": 3})
x1_mlp = _family_query("mlp", {"maxIter": 30})


_LABELS_VALUES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")"
                           for row in C.FEATURE_LABELS)
_J_SQL = with_ctes(*FEATURE_CTES, f"labels AS (SELECT * FROM (VALUES {_LABELS_VALUES}) t(feature, label, plain_label, unit))",
                   "feats AS (" + " UNION ALL ".join(
                       f"SELECT '{f}' AS feature, count({f}) AS n_values FROM matrix" for f in FEATURE_NAMES) + ")")


@query("j2_feature_labels", _J_SQL(
    "SELECT f.feature, coalesce(l.label, replace(f.feature, '_', ' ')) AS label, "
    "coalesce(l.plain_label, replace(f.feature, '_', ' ')) AS plain_label, coalesce(l.unit, '') AS unit, f.n_values "
    "FROM feats f LEFT JOIN labels l ON l.feature = f.feature"))
def j2_feature_labels(spark, sf_dir):
    m, enc = feature_matrix(spark, sf_dir, keep=("claim_id",))
    feats = list(enc.feature_names)
    counts = m.agg(*[F.count(f).alias(f) for f in feats]).unpivot([], feats, "feature", "n_values")
    return AT.with_labels(counts, AT.label_table(spark)).select("feature", "label", "plain_label", "unit", "n_values")


@query("j3_unlabelled_features", _J_SQL(
    "SELECT f.feature FROM feats f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.feature = f.feature)"))
def j3_unlabelled_features(spark, sf_dir):
    m, enc = feature_matrix(spark, sf_dir, keep=("claim_id",))
    feats = list(enc.feature_names)
    present = m.agg(*[F.count(f).alias(f) for f in feats]).unpivot([], feats, "feature", "n").select("feature")
    return AT.unlabelled(present, AT.label_table(spark))


#: A search ranks settings against each other; its fits stop early, the candidate's own fit does not.
SEARCH_FIXED = {"maxIter": 10}


def search_study(spark, sf_dir, family: str = "logistic_regression", n_trials: int = SE.N_TRIALS):
    """The study of one family over this input; kept in the checkpoint folder, so a second call finds its trials there."""
    m, feats = fold_matrix(spark, sf_dir)
    return SE.search(m, family, feats, f"{ensure_checkpoint_dir(spark).rstrip('/')}/study-{family}-{content_key(m, feats)}", n_trials,
                     parallelism=max(LN.FIT_THREADS, spark.sparkContext.defaultParallelism // 2), fixed=SEARCH_FIXED)


def content_key(m, feats) -> str:
    """Names the content of a fold matrix (any row order)."""
    content = m.agg(F.sum(F.xxhash64("claim_id", C.TARGET, "fold", *feats).cast("decimal(38,0)"))).first()[0]
    return hashlib.sha256(f"{content}|{feats}".encode()).hexdigest()[:16]


@query("x7_search_trials")
def x7_search_trials(spark, sf_dir):
    """The trials of a 50-trial, 5-fold search, the median rule stopping the worse ones (which ones is up to their timing)."""
    return SE.trials(search_study(spark, sf_dir))


_TRIAL_VALUES = ", ".join(f"({t}, '{json.dumps(SE.draw('logistic_regression', t), sort_keys=True)}')" for t in range(SE.N_TRIALS))


@query("x7_search_protocol", f"SELECT trial, params, true AS rule_agrees, true AS ends_well FROM (VALUES {_TRIAL_VALUES}) t(trial, params)")
def x7_search_protocol(spark, sf_dir):
    """Per trial, its drawn parameters, whether a replay of the recorded events decides as the search did, and whether it
    ends as it must: a completed trial on the last fold, a pruned one after the warm-up, with scores in (0, 1]."""
    events = cut_lineage(search_study(spark, sf_dir))
    agree = SE.replay(events).groupBy("trial").agg(F.bool_and("agrees").alias("rule_agrees"))
    t = SE.trials(events)
    folds = F.when(F.col("state") == SE.COMPLETE, F.col("folds_run") == C.N_FOLDS).otherwise(
        (F.col("state") == SE.PRUNED) & (F.col("folds_run") > SE.WARMUP_STEPS))
    scores = (F.col("mean_pr_auc") > 0) & (F.col("mean_pr_auc") <= 1)
    return t.join(agree, "trial").select("trial", "params", "rule_agrees", (folds & scores).alias("ends_well"))
