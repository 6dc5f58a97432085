"""Metric and drift properties (reference: evaluator / monitoring tests)."""

from pyspark.sql import functions as F

from claimscope.operators import drift as DR
from claimscope.operators import evaluate as EV


def test_roc_ap_match_bruteforce(spark):
    rows = [("m", 0, y, p) for y, p in [(1, .9), (0, .8), (1, .8), (0, .3), (1, .3), (0, .1), (0, .1), (1, .95)]]
    df = spark.createDataFrame(rows, "model string, fold int, y int, p double")
    got = EV.ranking_metrics(df, ["model"]).collect()[0]
    pos = [p for _, _, y, p in rows if y == 1]
    neg = [p for _, _, y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    # average precision as the step sum over distinct thresholds, descending
    ap, prev_r = 0.0, 0.0
    for t in sorted({p for *_, p in rows}, reverse=True):
        tp = sum(1 for *_, y, p in rows if p >= t and y == 1)
        fp = sum(1 for *_, y, p in rows if p >= t and y == 0)
        r = tp / len(pos)
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    assert abs(got.roc_auc - auc) < 1e-12 and abs(got.pr_auc - ap) < 1e-12


def test_threshold_scan_first_max_on_grid(spark):
    rows = [("m", 0, y, p) for y, p in [(1, .9), (0, .2), (1, .6), (0, .55), (0, .1), (1, .35)]]
    df = spark.createDataFrame(rows, "model string, fold int, y int, p double")
    best = EV.best_threshold(EV.grid_counts(df, ["model"]), ["model"]).collect()[0]
    grid = [0.05 + i * 0.01 for i in range(91)]

    def f1(t):
        tp = sum(1 for *_, y, p in rows if p >= t and y == 1)
        fp = sum(1 for *_, y, p in rows if p >= t and y == 0)
        fn = sum(1 for *_, y, p in rows if p < t and y == 1)
        return 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
    scores = [f1(t) for t in grid]
    assert abs(best.threshold - grid[scores.index(max(scores))]) < 1e-12


def test_stratified_folds_balanced(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("cid"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    f = EV.stratified_folds(df, "y", "cid")
    sizes = f.groupBy("y", "fold").count().collect()
    by = {}
    for r in sizes:
        by.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_psi_of_reference_against_itself_is_zero(spark):
    df = spark.range(800).select((F.col("id") * 37 % 1000).cast("double").alias("x"),
                                 (F.col("id") % 3).cast("double").alias("c"))
    spec = DR.build_reference(df, ["x", "c"])
    rep = DR.drift_report(spec, df, ["x", "c"]).collect()
    assert all(r.psi == 0.0 and r.status == "stable" for r in rep)


def test_psi_shift_alarms_and_small_batch_skips(spark):
    ref = spark.range(800).select((F.col("id") % 400).cast("double").alias("x"))
    cur = spark.range(400).select(((F.col("id") % 400) * 1.6).cast("double").alias("x"))
    spec = DR.build_reference(ref, ["x"])
    rep = DR.drift_report(spec, cur, ["x"]).collect()
    assert rep[0].status == "alarm"
    small = spark.range(50).select(F.col("id").cast("double").alias("x"))
    assert DR.drift_report(spec, small, ["x"]).count() == 0
    assert DR.drift_summary(DR.drift_report(spec, small, ["x"]), 50).collect()[0].skipped.startswith("batch of 50")
