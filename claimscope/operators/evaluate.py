"""Evaluation on score tables.

Inputs are long tables ``(model, fold, y, p)``: one row per scored claim per
candidate. Every metric is a grouped aggregate; the running sums that ROC-AUC,
average precision and the threshold scan need are computed per distinct score
with a two-level window (bucket offsets on a bounded side table + a window inside
each bucket), so no task ever holds a whole fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope import config as C

PREFIX_HEX = 4       # fold-assignment buckets: 16**4 per class (offset table <= 2 * 65536 rows)
SCORE_BUCKETS = 4096  # running-sum buckets over [0, 1] scores (offset table <= keys * 4096 rows)


def rnd(c, digits: int) -> Column:
    """Half-up rounding at ``digits`` (identical expression in the oracle SQL)."""
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with 0 on a zero denominator (metric convention for 0/0)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ------------------------------------------------------------------------------------------ W3

def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = C.N_FOLDS,
                     seed: int = C.RANDOM_STATE, fold_col: str = "fold") -> DataFrame:
    """Seeded, class-balanced fold ids without a global sort in one task.

    Rows are ordered within their class by ``md5(id|seed)``; fold = rank mod k. The
    rank is the row's position inside its md5-prefix bucket plus the size of all
    earlier buckets of the class (a side table of at most 2 * 16**4 rows).
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    keyed = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, PREFIX_HEX))
    sizes = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(label, "__b").orderBy("__h", id_col)
    ranked = keyed.join(F.broadcast(offsets), [label, "__b"]).withColumn(
        fold_col, ((F.col("__off") + F.row_number().over(inside) - 1) % k).cast("int"))
    return ranked.drop("__h", "__b", "__off")


# ------------------------------------------------------------------------------------------ W4

def cumulative_before(counts: DataFrame, keys: list[str], order_col: str, values: list[str],
                      buckets: int = SCORE_BUCKETS, lo=0.0, hi=1.0) -> DataFrame:
    """Add ``<v>_before``: sum of v over rows with the same keys and a smaller ``order_col``.

    ``counts`` has one row per distinct (keys, order_col). Offsets of whole buckets
    come from a bounded side table; the remainder from a window inside one bucket.
    """
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    span = F.when(hi_c > lo_c, hi_c - lo_c).otherwise(F.lit(1.0))
    b = F.least(F.greatest(F.floor((F.col(order_col) - lo_c) / span * buckets), F.lit(0)),
                F.lit(buckets - 1)).cast("int")
    c = counts.withColumn("__bk", b)
    tot = c.groupBy(*keys, "__bk").agg(*[F.sum(v).alias(v) for v in values])
    prev = Window.partitionBy(*keys).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, "__bk", *[F.coalesce(F.sum(v).over(prev), F.lit(0)).alias(f"__o_{v}")
                                      for v in values])
    inside = Window.partitionBy(*keys, "__bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = c.join(F.broadcast(off), [*keys, "__bk"])
    return out.select(*[c for c in counts.columns if c != "__bk"], *[
        (F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__o_{v}")).alias(f"{v}_before")
        for v in values])


def score_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score (partial aggregation before the shuffle)."""
    return scored.groupBy(*keys, "p").agg(F.sum("y").cast("long").alias("pos"),
                                          F.sum(1 - F.col("y")).cast("long").alias("neg"))


def ranking_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """A14 ROC-AUC (mid-rank ties) and A15 average precision (step sum, not trapezoid)."""
    counts = score_counts(scored, keys)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))  # one row per group of keys
    c = cumulative_before(counts, keys, "p", ["pos", "neg"]).join(totals, keys)
    # positives and negatives scored at or above this score
    tp = F.col("n_pos") - F.col("pos_before")
    fp = F.col("n_neg") - F.col("neg_before")
    return c.groupBy(*keys).agg(
        safe_div(F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))),
                 F.first("n_pos") * F.first("n_neg")).alias("roc_auc"),
        safe_div(F.sum(F.col("pos") * safe_div(tp, tp + fp)), F.first("n_pos")).alias("pr_auc"))


# ------------------------------------------------------------------------------------------ A17

def grid_value(i) -> Column:
    i = F.col(i) if isinstance(i, str) else i
    return F.lit(C.THRESHOLD_RANGE[0]) + i.cast("double") * F.lit(C.THRESHOLD_STEP)


N_GRID = int(round((C.THRESHOLD_RANGE[1] - C.THRESHOLD_RANGE[0]) / C.THRESHOLD_STEP)) + 1


def grid_count(p: Column) -> Column:
    """Number of grid thresholds <= p (rows with this count are predicted positive for i < count)."""
    est = F.least(F.greatest(F.floor((p - F.lit(C.THRESHOLD_RANGE[0])) / F.lit(C.THRESHOLD_STEP)) + 1,
                             F.lit(0)), F.lit(N_GRID)).cast("int")
    up = F.when((est < N_GRID) & (grid_value(est) <= p), est + 1).otherwise(est)
    return F.when((up > 0) & (grid_value(up - 1) > p), up - 1).otherwise(up)


def best_threshold(counts: DataFrame, keys: list[str], metric: str = "f1_declined") -> DataFrame:
    """A17 from per-(keys, grid count) positives/negatives: first grid maximum of F1 or recall.

    Thresholds between two observed counts share one confusion matrix, so each block is
    represented by its lowest threshold and the first maximum is the lowest index.
    """
    w_all = Window.partitionBy(*keys)
    suffix = Window.partitionBy(*keys).orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, 0)
    t = counts.withColumns({
        "P": F.sum("pos").over(w_all),
        "S_pos": F.sum("pos").over(suffix), "S_neg": F.sum("neg").over(suffix)})
    t = t.where(F.col("c") >= 1)
    t = t.withColumn("i", F.coalesce(F.lag("c").over(Window.partitionBy(*keys).orderBy("c")), F.lit(0)))
    tp, fp = F.col("S_pos"), F.col("S_neg")
    fn = F.col("P") - tp
    value = (safe_div(2 * tp, 2 * tp + fp + fn) if metric == "f1_declined" else safe_div(tp, tp + fn))
    t = t.withColumn("value", value)
    pick = Window.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("i").asc())
    best = t.withColumn("__r", F.row_number().over(pick)).where(F.col("__r") == 1)
    return best.select(*keys, grid_value("i").alias("threshold"), F.col("value").alias(metric))


def grid_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, grid_count(F.col("p")).alias("c")).agg(
        F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def training_part_thresholds(scored: DataFrame, model_col: str = "model") -> DataFrame:
    """Per (model, fold): threshold chosen on the other folds' scores only (no peeking)."""
    per_fold = grid_counts(scored, [model_col, "fold"])
    totals = per_fold.groupBy(model_col, "c").agg(F.sum("pos").alias("tpos"), F.sum("neg").alias("tneg"))
    folds = per_fold.select(model_col, "fold").distinct()
    # every (model, fold, c) cell of the training part = totals minus the fold's own cell
    cells = totals.join(folds, model_col).join(
        per_fold, [model_col, "fold", "c"], "left").select(
        model_col, "fold", "c",
        (F.col("tpos") - F.coalesce("pos", F.lit(0))).alias("pos"),
        (F.col("tneg") - F.coalesce("neg", F.lit(0))).alias("neg"))
    return best_threshold(cells, [model_col, "fold"])


# ------------------------------------------------------------------------------------------ A13

def confusion_at(scored: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and precision/recall/F1 (0 on 0/0) at each group's threshold."""
    j = scored.join(F.broadcast(thresholds.select(*keys, "threshold")), keys)
    pred = (F.col("p") >= F.col("threshold")).cast("int")
    agg = j.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.sum(((pred == 0) & (F.col("y") == 0)).cast("long")).alias("true_negatives"),
        F.sum(((pred == 1) & (F.col("y") == 0)).cast("long")).alias("false_positives"),
        F.sum(((pred == 0) & (F.col("y") == 1)).cast("long")).alias("false_negatives"),
        F.sum(((pred == 1) & (F.col("y") == 1)).cast("long")).alias("true_positives"),
        F.count(F.lit(1)).alias("n_val"), F.sum("y").cast("long").alias("n_declined"),
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return agg.withColumns({
        "precision_declined": safe_div(tp, tp + fp),
        "recall_declined": safe_div(tp, tp + fn),
        "f1_declined": safe_div(2 * tp, 2 * tp + fp + fn)})


def fold_metrics(scored: DataFrame, threshold_search: bool = True, model_col: str = "model") -> DataFrame:
    """X5/A13-A16 per (model, fold): threshold from the training part, metrics on the fold."""
    keys = [model_col, "fold"]
    if threshold_search:
        th = training_part_thresholds(scored, model_col)
    else:
        th = scored.select(*keys).distinct().withColumn("threshold", F.lit(0.5))
    return confusion_at(scored, th, keys).join(ranking_metrics(scored, keys), keys)


METRICS = ("f1_declined", "recall_declined", "precision_declined", "roc_auc", "pr_auc", "brier")


def cv_summary(folds: DataFrame, model_col: str = "model") -> DataFrame:
    """Mean and population std over folds, rounded 4 (thresholds 3)."""
    return folds.groupBy(model_col).agg(
        *[rnd(F.avg(m), 4).alias(m) for m in METRICS],
        rnd(F.stddev_pop("f1_declined"), 4).alias("f1_std"),
        rnd(F.avg("threshold"), 3).alias("threshold"),
        rnd(F.stddev_pop("threshold"), 3).alias("threshold_std"))


def comparison_frame(summary: DataFrame) -> DataFrame:
    """O1: models ranked by F1 (descending)."""
    return summary.orderBy(F.col("f1_declined").desc(), F.col("model"))


def top_candidates(summary: DataFrame, n: int = C.TOP_CANDIDATES) -> DataFrame:
    """O2: the first n of the comparison."""
    return comparison_frame(summary).limit(n)


def baseline_metrics(labels: DataFrame) -> DataFrame:
    """Constant 'Completed' classifier."""
    return labels.agg((1 - F.avg("y")).alias("accuracy"), F.lit(0.0).alias("f1_declined"),
                      F.lit(0.0).alias("recall_declined"))


def pooled_confusion(folds: DataFrame, model_col: str = "model") -> DataFrame:
    """Confusion summed over folds, accuracy and the constant classifier's accuracy."""
    s = folds.groupBy(model_col).agg(*[F.sum(c).alias(c) for c in (
        "true_negatives", "false_positives", "false_negatives", "true_positives")])
    total = sum((F.col(c) for c in ("true_negatives", "false_positives", "false_negatives",
                                    "true_positives")), F.lit(0))
    return s.withColumns({
        "accuracy": safe_div(F.col("true_negatives") + F.col("true_positives"), total),
        "constant_accuracy": safe_div(F.col("true_negatives") + F.col("false_positives"), total)})


def decile_lift(scored: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Quantile bins (linear edges, duplicates dropped, right-closed) and lift vs base rate."""
    qs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    edges = scored.groupBy(*keys).agg(F.array_distinct(F.percentile("p", qs)).alias("edges"),
                                      F.avg("y").alias("base_rate"))
    inner = F.slice("edges", 2, F.size("edges") - 2)
    j = scored.join(F.broadcast(edges), keys)
    d = j.withColumn("decile", F.size(F.filter(inner, lambda e: e < F.col("p"))))
    return d.groupBy(*keys, "decile").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("declines"),
        F.avg("y").alias("rate"), F.first("base_rate").alias("base_rate")).withColumn(
        "lift", F.col("rate") / F.col("base_rate")).drop("base_rate")


def calibration_curve(scored: DataFrame, keys: list[str], n_bins: int = 10) -> DataFrame:
    """Quantile bins (edges kept), mean predicted vs observed rate; empty bins absent."""
    qs = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    edges = scored.groupBy(*keys).agg(F.percentile("p", qs).alias("edges"))
    inner = F.slice("edges", 2, n_bins - 1)
    j = scored.join(F.broadcast(edges), keys)
    b = j.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("p"))))
    return b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"),
                                       F.avg("p").alias("mean_predicted"),
                                       F.avg("y").alias("observed_rate"))


def band_of(p: Column) -> Column:
    """A23 bands, right-closed: (-.01,.30], (.30,.70], (.70,1.01]."""
    (lo0, hi0, b0), (_, hi1, b1), (_, _, b2) = C.ROUTING_BANDS
    return F.when(p <= hi0, b0).when(p <= hi1, b1).otherwise(b2)


def routing_bands(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Claims, declines, decline rate, share of volume and of declines, score spread per band."""
    g = scored.groupBy(*keys, band_of(F.col("p")).alias("band")).agg(
        F.count(F.lit(1)).alias("claims"), F.sum("y").cast("long").alias("declines"),
        F.avg("y").alias("decline_rate"), F.min("p").alias("score_min"),
        F.percentile("p", 0.5).alias("score_median"), F.max("p").alias("score_max"))
    w = Window.partitionBy(*keys)  # over the three band rows of each group
    return g.withColumns({
        "share_volume": F.col("claims") / F.sum("claims").over(w),
        "share_declines": safe_div(F.col("declines"), F.sum("declines").over(w))})


def weighted_decision(summary: DataFrame, weights: dict, model_col: str = "model") -> DataFrame:
    """Min-max normalise each criterion over candidates by direction (constant -> 1), weight, rank."""
    allw = Window.partitionBy()  # over the handful of candidate rows
    score = F.lit(0.0)
    for col, (w, direction) in weights.items():
        v = F.col(col).cast("double")
        lo, hi = F.min(v).over(allw), F.max(v).over(allw)
        norm = F.when(hi == lo, F.lit(1.0)).otherwise(
            (v - lo) / (hi - lo) if direction == "max" else (hi - v) / (hi - lo))
        score = score + norm * F.lit(w)
    out = summary.withColumn("weighted_score", rnd(score, 4))
    return out.withColumn("rank", F.row_number().over(
        Window.partitionBy().orderBy(F.col("weighted_score").desc(), F.col(model_col))))


def best_and_worst(summary: DataFrame, panels: dict, model_col: str = "model") -> DataFrame:
    """Per metric, best and worst candidate by the metric's direction."""
    long = summary.select(model_col, *[F.col(m).cast("double").alias(m) for m in panels]).unpivot(
        [model_col], list(panels), "metric", "value")
    dirs = F.create_map(*[x for m, d in panels.items() for x in (F.lit(m), F.lit(d))])
    sign = F.when(F.element_at(dirs, F.col("metric")) == "max", F.lit(1.0)).otherwise(F.lit(-1.0))
    s = long.withColumn("__s", F.col("value") * sign)
    return s.groupBy("metric").agg(
        F.max_by(model_col, F.struct("__s", F.col(model_col))).alias("best"),
        F.min_by(model_col, F.struct("__s", F.col(model_col))).alias("worst"))


def seeded_sample(df: DataFrame, id_col: str, n: int = C.SAMPLE_ROWS, seed: int = C.RANDOM_STATE) -> DataFrame:
    """Deterministic n-row sample: the n smallest md5(id|seed) (top-k, no global sort task)."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))
    return df.withColumn("__h", h).orderBy("__h").limit(n).drop("__h")
