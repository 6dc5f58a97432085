"""Population-stability drift between a frozen reference and a batch (M1-M9).

Both sides are unpivoted once to ``(feature, value)``; the reference is one grouped
pass (value counts, distinct counts, quantile edges) and the batch is one join to
the small per-feature spec plus one grouped count. The spec table has one row per
(feature, bin) -- at most 12 or ``n_bins`` bins per feature -- so it is broadcast.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions.format import general
from claimscope.operators.evaluate import rnd
from claimscope.operators.quantiles import exact_quantiles, linspace_quantiles
from claimscope.session import cut_lineage


def to_long(df: DataFrame, features) -> DataFrame:
    """(feature, value) with value coerced to double; nulls kept (they count in the floor)."""
    cols = list(features)
    return df.select(*[F.col(c).try_cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value")


def _numeric(v):
    return v.isNotNull() & ~F.isnan(v)


def build_reference(df: DataFrame, features, n_bins: int = C.PSI_N_BINS,
                    max_categorical: int = C.CATEGORICAL_MAX_CARDINALITY) -> DataFrame:
    """M1: spec rows (feature, kind, bin, lo, hi, value, share, inner_edges, cat_values).

    <= 12 distinct values: one bin per value, share = count / non-null count.
    Otherwise: unique linear quantile edges, outer edges replaced by -inf/+inf,
    bins left-closed (last closed), share = count / non-null count.
    """
    long = to_long(df, features).where(_numeric(F.col("value")))
    vc = cut_lineage(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))       # read five times
    stats = vc.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_clean"))
    numeric_feats = stats.where(F.col("n_distinct") > max_categorical).select("feature")
    q = exact_quantiles(vc.join(numeric_feats, "feature", "left_semi"), ["feature"],
                        linspace_quantiles(n_bins))
    edges = q.groupBy("feature").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("qi", "edge"))),
                                     lambda s: s["edge"])).alias("edges"))
    # numeric bins: i = 0..len(edges)-2 with outer edges opened to +-inf
    numeric = edges.select(
        "feature", F.slice("edges", 2, F.size("edges") - 2).alias("inner_edges"),
        F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("bin", "lo_raw"), "edges")
    numeric = numeric.select(
        "feature", F.lit("numeric").alias("kind"), F.col("bin").cast("int").alias("bin"),
        F.when(F.col("bin") == 0, F.lit(float("-inf"))).otherwise(F.col("lo_raw")).alias("lo"),
        F.when(F.col("bin") == F.size("edges") - 2, F.lit(float("inf")))
        .otherwise(F.element_at("edges", F.col("bin") + 2)).alias("hi"),
        F.lit(None).cast("double").alias("value"), "inner_edges",
        F.lit(None).cast("array<double>").alias("cat_values"))
    # reference counts per numeric bin: number of inner edges <= x
    ref_num = (vc.join(F.broadcast(numeric.select("feature", "inner_edges").distinct()), "feature")
               .withColumn("bin", F.size(F.filter("inner_edges", lambda e: e <= F.col("value"))).cast("int"))
               .groupBy("feature", "bin").agg(F.sum("n").alias("cnt")))
    numeric = numeric.join(ref_num, ["feature", "bin"], "left")
    cat_feats = stats.where(F.col("n_distinct") <= max_categorical).select("feature")
    w = Window.partitionBy("feature").orderBy("value")  # <= 12 rows per feature
    categorical = vc.join(cat_feats, "feature", "left_semi").select(
        "feature", F.lit("categorical").alias("kind"), (F.row_number().over(w) - 1).cast("int").alias("bin"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), "value",
        F.lit(None).cast("array<double>").alias("inner_edges"),
        F.collect_list("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("cat_values"), F.col("n").alias("cnt"))
    spec = numeric.unionByName(categorical).join(stats.select("feature", "n_clean"), "feature")
    return spec.select("feature", "kind", "bin", "lo", "hi", "value", "inner_edges", "cat_values",
                       (F.coalesce(F.col("cnt"), F.lit(0)) / F.col("n_clean")).alias("share"))


def bin_of(spec_row_edges, spec_row_values, x):
    """Bin index of x: numeric = inner edges <= x; categorical = position in values (-1 unseen)."""
    return F.when(spec_row_values.isNotNull(), F.array_position(spec_row_values, x).cast("int") - 1) \
        .otherwise(F.size(F.filter(spec_row_edges, lambda e: e <= x)).cast("int"))


def score_batch(spec: DataFrame, batch: DataFrame, features, ignore=C.PSI_IGNORE,
                watch: float = C.PSI_WATCH, alarm: float = C.PSI_ALARM) -> DataFrame:
    """M2-M4: per feature PSI with the floor 1/(2*batch rows), worst bin and status."""
    present = [f for f in features if f in batch.columns and f not in ignore]
    n_rows = batch.select(F.count(F.lit(1))).scalar()  # scalar subquery, stays in the plan
    floor = F.lit(1.0) / (F.lit(2.0) * F.greatest(n_rows, F.lit(1)))
    per_feature = spec.select("feature", "inner_edges", "cat_values").dropDuplicates(["feature"])
    long = to_long(batch, present).where(_numeric(F.col("value")))
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))                    # a value is binned once, not once a row
    counted = (vc.join(F.broadcast(per_feature), "feature")
               .withColumn("bin", bin_of(F.col("inner_edges"), F.col("cat_values"), F.col("value")))
               .groupBy("feature", "bin").agg(F.sum("n").alias("cnt")))
    clean = counted.groupBy("feature").agg(F.sum("cnt").alias("n_clean"))
    cur = (spec.where(F.col("feature").isin(*present)).select("feature", "bin", F.col("share").alias("ref_share"))
           .join(counted, ["feature", "bin"], "left").join(clean, "feature", "left")
           .withColumn("cur_share", F.coalesce(F.try_divide(F.col("cnt"), F.col("n_clean")), F.lit(0.0))))
    r = F.greatest(F.col("ref_share"), floor)
    c = F.greatest(F.col("cur_share"), floor)
    contrib = cur.withColumn("contrib", (c - r) * F.ln(c / r))
    worst = Window.partitionBy("feature").orderBy(F.abs("contrib").desc(), F.col("bin").asc())
    ranked = contrib.withColumns({"psi": F.sum("contrib").over(Window.partitionBy("feature")),
                                  "__r": F.row_number().over(worst)})
    top = ranked.where(F.col("__r") == 1)
    status = (F.when(F.col("psi") >= alarm, "alarm").when(F.col("psi") >= watch, "watch").otherwise("stable"))
    return top.select("feature", "psi", status.alias("status"), F.col("bin").alias("largest_shift_bin"),
                      F.col("ref_share").alias("reference_share"), F.col("cur_share").alias("current_share"))


def drift_report(spec: DataFrame, batch: DataFrame, features, min_rows: int = C.PSI_MIN_ROWS) -> DataFrame:
    """M5-M6: features by PSI (4 dp); empty with a reason when the batch is under ``min_rows``."""
    n = batch.count()
    if n < min_rows:
        return batch.sparkSession.createDataFrame(
            [], "feature string, psi double, status string, largest_shift_bin int, "
                "reference_share double, current_share double")
    s = score_batch(spec, batch, features)
    return s.select("feature", rnd("psi", 4).alias("psi"), "status", "largest_shift_bin",
                    rnd("reference_share", 4).alias("reference_share"),
                    rnd("current_share", 4).alias("current_share")).orderBy(F.col("psi").desc(), "feature")


def drift_summary(report: DataFrame, n_rows: int, min_rows: int = C.PSI_MIN_ROWS,
                  score_feature: str = C.SCORE_FEATURE) -> DataFrame:
    """M6 verdict: counts of alarms/watches (features only), investigation if any alarm incl. score."""
    skipped = (f"batch of {n_rows} rows is below the {min_rows}-row minimum" if n_rows < min_rows else None)
    feats = F.col("feature") != score_feature
    agg = report.agg(
        F.count_if(feats & (F.col("status") == "alarm")).alias("n_alarms"),
        F.count_if(feats & (F.col("status") == "watch")).alias("n_watches"),
        F.coalesce(F.bool_or(F.col("status") == "alarm"), F.lit(False)).alias("requires_investigation"))
    return agg.select(F.lit(n_rows).cast("long").alias("n_rows"), F.lit(skipped).cast("string").alias("skipped"),
                      "n_alarms", "n_watches", "requires_investigation")


def triage(summary_by_batch: DataFrame, score_feature: str = C.SCORE_FEATURE) -> DataFrame:
    """M8: (feature alarm?, score alarm?) -> action."""
    fa, sa = F.col("features_alarm"), F.col("score_alarm")
    action = (F.when(~fa & ~sa, "none").when(fa & ~sa, "investigate source data")
              .when(~fa & sa, "check for model regression").otherwise("retrain candidate"))
    return summary_by_batch.withColumn("action", action)


def bin_labels(spec: DataFrame) -> DataFrame:
    """(feature, bin, label): ``=value`` for a categorical bin, ``(low, high]`` for a numeric one."""
    numeric = F.concat(F.lit("("), general(F.col("lo")), F.lit(", "), general(F.col("hi")), F.lit("]"))
    return spec.select("feature", "bin", F.when(F.col("kind") == "categorical", F.concat(F.lit("="), general(F.col("value"))))
                       .otherwise(numeric).alias("label"))


def version_check(reference_meta: DataFrame, serving_version: str) -> DataFrame:
    """M9: the frozen reference must carry the serving model's version."""
    return reference_meta.select("model_version", F.lit(serving_version).alias("serving_version"),
                                 (F.col("model_version") == F.lit(serving_version)).alias("matches"))


def save_reference(spec: DataFrame, path: str, model_version: str) -> None:
    """SNK3/M7: freeze a reference beside the model version it belongs to. A version's reference is written once; a second
    attempt is an error, since reports already made refer to it."""
    spec.withColumn("model_version", F.lit(str(model_version))).write.mode("error").parquet(f"{path}/version={model_version}/reference")


def load_reference(spark: SparkSession, path: str, serving_version: str) -> DataFrame:
    """The reference of the serving version; ValueError if there is none or if it was made for another version."""
    try:
        spec = spark.read.parquet(f"{path}/version={serving_version}/reference")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no drift reference for version {serving_version} in {path}") from None
    other = version_check(spec.select("model_version").distinct(), str(serving_version)).where("not matches").first()
    if other is not None:
        raise ValueError(f"the drift reference belongs to version {other.model_version}, not to {serving_version}")
    return spec.drop("model_version")
