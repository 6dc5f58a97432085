"""Candidate models, batch scoring and cross-validation on Spark ML.

Each fit is a distributed ``Pipeline.fit``; folds and trials are short driver loops, run side by side by a
bounded pool of threads over one stored matrix, never loops over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators.evaluate import best_threshold, confusion_at, grid_counts, ranking_metrics, stratified_folds
from claimscope.operators.oversample import oversample
from claimscope.session import cut_lineage

T = TypeVar("T")
FAMILIES = ("logistic_regression", "random_forest", "gbt", "mlp")
TREE_FAMILIES = ("random_forest", "gbt")
#: Fits that the driver keeps running side by side.
FIT_THREADS = 4


def with_class_weight(df: DataFrame, label: str = C.TARGET, weight_col: str = "weight",
                      positive_weight: float | None = None) -> DataFrame:
    """'balanced' weights n / (2 * n_class), or a fixed positive-class weight (5.36)."""
    if positive_weight is not None:
        return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0)))
    n, pos = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()             # once, not in every job of the fit
    return balanced(df, n, pos, label, weight_col)


def balanced(df: DataFrame, n: int, pos: int, label: str = C.TARGET, weight_col: str = "weight") -> DataFrame:
    """The 'balanced' weights of a part of ``n`` rows, ``pos`` of them positive."""
    w_pos, w_neg = n / (2.0 * max(pos, 1)), n / (2.0 * max(n - pos, 1))
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)).cast("double"))


def forest_inputs(df: DataFrame, features) -> DataFrame:
    """F13 (trees): constant -1 for missing, so 'not assessed' stays a distinct value."""
    return df.fillna(-1.0, subset=list(features)).fillna(-1, subset=list(features))


def missing_columns(df: DataFrame, features) -> list[str]:
    """The features that lack a value (null or NaN) in some row of ``df``; one pass."""
    absent = lambda f: F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    found = df.agg(*[F.max(absent(f)).alias(f) for f in features]).first()
    return [f for f in features if found[f]]


def imputation(features, imputed=None) -> tuple[list, list[str]]:
    """(stages, columns to assemble): medians of the training part for the features ``imputed`` (None: all of them).

    A median is a sketch of a whole column, the dearest step of a fit, and changes nothing where no row lacks a value.
    """
    feats = list(features)
    gaps = feats if imputed is None else [f for f in feats if f in set(imputed)]
    stages = [Imputer(strategy="median", inputCols=gaps, outputCols=[f"__i_{f}" for f in gaps])] if gaps else []
    return stages, [f"__i_{f}" if f in set(gaps) else f for f in feats]


def build_model(name: str, features, params: dict | None = None, seed: int = C.RANDOM_STATE, imputed=None) -> Pipeline:
    """Candidate pipelines by name; class weighting where the estimator supports it.

    ``imputed``: the features with missing values among all rows to be fitted and scored (``missing_columns``); None if not known.
    """
    p = dict(params or {})
    feats = list(features)
    if name == "logistic_regression":
        imp, filled = imputation(feats, imputed)
        va = VectorAssembler(inputCols=filled, outputCol="__raw")
        sc = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)
        lr = LogisticRegression(labelCol=C.TARGET, weightCol="weight", maxIter=p.get("maxIter", 100),
                                regParam=p.get("regParam", 0.0))
        return Pipeline(stages=[*imp, va, sc, lr])
    if name == "mlp":
        imp, filled = imputation(feats, imputed)
        va = VectorAssembler(inputCols=filled, outputCol="__raw")
        sc = StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)
        mlp = MultilayerPerceptronClassifier(labelCol=C.TARGET, layers=[len(feats), *p.get("hidden", [16]), 2],
                                             maxIter=p.get("maxIter", 100), seed=seed)
        return Pipeline(stages=[*imp, va, sc, mlp])
    va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
    if name == "random_forest":
        est = RandomForestClassifier(labelCol=C.TARGET, weightCol="weight", seed=seed,
                                     numTrees=p.get("numTrees", 20), maxDepth=p.get("maxDepth", 5),
                                     minInstancesPerNode=p.get("minInstancesPerNode", 1),
                                     featureSubsetStrategy=p.get("featureSubsetStrategy", "auto"))
    elif name == "gbt":
        est = GBTClassifier(labelCol=C.TARGET, weightCol="weight", seed=seed, maxIter=p.get("maxIter", 20),
                            maxDepth=p.get("maxDepth", 4), stepSize=p.get("stepSize", 0.1),
                            subsamplingRate=p.get("subsamplingRate", 1.0), minInstancesPerNode=p.get("minInstancesPerNode", 1))
    else:
        raise ValueError(f"no candidate family {name!r}; there are {', '.join(FAMILIES)}")
    return Pipeline(stages=[va, est])


def score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """P(Declined) for each row."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        *[c for c in scored.columns if c.startswith("__") or c in ("features", "rawPrediction", "probability")])


def run_fits(tasks: list[Callable[[], T]], parallelism: int = FIT_THREADS) -> list[T]:
    """Results of driver-side tasks that each start Spark jobs, at most ``parallelism`` of them side by side.

    The pool holds models and plans, never rows: a fit that leaves executors idle (a small training part, the last
    wave of a stage) lets the next one's tasks in. The first failure is raised after the others ended.
    """
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        session = SparkSession.active()
        # local properties are copied once per task: shared, one thread's query ids would overwrite another's
        futures = [pool.submit(inheritable_thread_target(session)(t)) for t in tasks]
        return [f.result() for f in futures]


def family_inputs(df: DataFrame, name: str, features) -> DataFrame:
    """-1 for missing values in tree families; the others keep nulls, which their pipeline imputes from its training part."""
    return forest_inputs(df, features) if name in TREE_FAMILIES else df


@dataclass
class PreparedPart:
    """A training part and its held rows as vectors: imputed, scaled and weighted by what was fitted on the training part alone."""

    train: DataFrame
    held: DataFrame
    n_train: int


def prepare(name: str, train: DataFrame, held: DataFrame, features, facts: tuple | None = None) -> PreparedPart:
    """F13 without the estimator, stored: every setting tried on a part shares it. Not for mlp, which balances its part by itself.

    ``facts``: (counts, medians, the columns with gaps) of the part (``part_facts``), if known.
    """
    features = list(features)
    if facts is None:
        gaps = [] if name in TREE_FAMILIES else missing_columns(train.select(*features).unionByName(held.select(*features)), features)
        (counts, medians), = part_facts(train, [F.lit(True)], gaps)
    else:
        counts, medians, gaps = facts
    if medians:
        train, held = train.fillna(medians), held.fillna(medians)
    pre = Pipeline(stages=build_model(name, features, imputed=[f for f in gaps if f not in medians]).getStages()[:-1])
    weighted = balanced(family_inputs(train, name, features), *counts)
    model = pre.fit(weighted)
    ready = cut_lineage(model.transform(weighted).select(C.TARGET, "weight", "features"))
    return PreparedPart(ready, cut_lineage(model.transform(family_inputs(held, name, features)).select(C.TARGET, "features")), counts[0])


def fit(name: str, train: DataFrame | PreparedPart, features, params: dict | None = None, seed: int = C.RANDOM_STATE,
        imputed=None, counts: tuple[int, int] | None = None) -> PipelineModel:
    """X1 + F13: one candidate on one training part; imputation, scaling and class weights come from that part alone.

    ``C`` (inverse strength of a penalty on the summed loss) becomes the estimator's penalty on the mean loss. Of a prepared part
    only the estimator is fitted, for the part's ``held`` rows to be scored by. ``imputed``: see ``build_model``; ``counts``: the part's
    rows and positive rows, if known.
    """
    params = dict(params or {})
    prepared = isinstance(train, PreparedPart)
    if "C" in params:
        params["regParam"] = 1.0 / (params.pop("C") * max(train.n_train if prepared else train.count(), 1))
    pipeline = build_model(name, features, params, seed, imputed)
    if prepared:
        return PipelineModel([pipeline.getStages()[-1].fit(train.train)])
    if name == "mlp":                                            # takes no weights: the part is balanced instead, after scaling
        pre = Pipeline(stages=pipeline.getStages()[:-1]).fit(train)
        ready = cut_lineage(pre.transform(train).select("claim_id", C.TARGET, vector_to_array("features").alias("vector")))
        both = ready.select(C.TARGET, "vector").unionByName(oversample(ready, seed=seed).select(C.TARGET, "vector"))
        model = pipeline.getStages()[-1].fit(both.select(C.TARGET, array_to_vector("vector").alias("features")))
        return PipelineModel([*pre.stages, model])
    rows = family_inputs(train, name, features)
    return pipeline.fit(balanced(rows, *counts) if counts else with_class_weight(rows))


def with_inner_folds(data: DataFrame, k: int = C.N_FOLDS, inner: int = C.INNER_FOLDS, label: str = C.TARGET, id_col: str = "claim_id",
                     fold_col: str = "fold", seed: int = C.RANDOM_STATE + 1) -> DataFrame:
    """Adds ``inner`` (map): for every outer fold a row trains in, its stratified inner fold there.

    All outer folds are ranked in one pass: a row stands once per training part, in strata (outer fold, label).
    """
    train = data.select(id_col, label, fold_col, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("outer")).where(F.col("outer") != F.col(fold_col))
    strata = train.select(id_col, "outer", F.concat_ws("|", "outer", label).alias("stratum"))
    ranked = stratified_folds(strata, "stratum", id_col, inner, seed, "inner")
    per_row = ranked.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("outer", "inner"))).alias("inner"))
    return data.join(per_row, id_col)


def part_facts(data: DataFrame, trains: list, gaps: list[str], label: str = C.TARGET) -> list[tuple[tuple[int, int], dict]]:
    """((rows, positive rows), medians of the columns ``gaps``) of every training part, all parts in one pass.

    ``trains``: a condition per part. Medians have the imputer's accuracy and leave out nulls and NaN; a column without any value has none.
    """
    numbers = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in enumerate(trains)]))
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    rows = data.select(numbers.alias("parts"), label, *gaps).select(F.explode("parts").alias("part"), label, *gaps).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("pos"),
        *[F.percentile_approx(known(f), 0.5, 1000).alias(f"m_{f}") for f in gaps]).collect()              # one row per part
    found = {r["part"]: ((r["n"], r["pos"]), {f: r[f"m_{f}"] for f in gaps if r[f"m_{f}"] is not None}) for r in rows}
    return [found.get(n, ((0, 0), {})) for n in range(len(trains))]


def nested_scores(data: DataFrame, name: str, features, params: dict | None = None, k: int = C.N_FOLDS, inner: int = C.INNER_FOLDS,
                  id_col: str = "claim_id", parallelism: int = FIT_THREADS) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, inner scores) of nested cross-validation.

    ``data``: features, label, ``fold``, ``inner`` (``with_inner_folds``), stored. Every fit reads it several times, so it is held
    by columns until all parts are scored; one pass counts the classes and finds the medians of all parts. Out-of-fold rows:
    (id, fold, y, p, model), scored by the fit on the other folds. Inner rows: (id, fold, inner, y, p, model), where
    ``fold`` is the outer fold held out and p comes from a fit that saw neither that fold nor the row's own inner fold. Both are stored.
    """
    mine = F.col("inner")
    if name in TREE_FAMILIES:                                    # nothing is fitted before the trees: vectors are assembled once for all parts
        data = cut_lineage(build_model(name, features, params).getStages()[0].transform(forest_inputs(data, features)).select(id_col, C.TARGET, "fold", "inner", "features"))

    cuts = [(F.col("fold") != o, F.col("fold") == o, ["fold"]) for o in range(k)]
    cuts += [((F.col("fold") != o) & (mine[o] != i), (F.col("fold") != o) & (mine[o] == i), [F.lit(o).alias("fold"), mine[o].alias("inner")])
             for o in range(k) for i in range(inner)]
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        gaps = [] if name in TREE_FAMILIES else missing_columns(data, features)
        facts = part_facts(data, [train for train, _, _ in cuts], gaps)

        def part(number, train, held, columns):
            def go():
                counts, medians = facts[number]
                filled = data.fillna(medians) if medians else data
                rows, scored = filled.where(train), filled.where(held)
                if name in TREE_FAMILIES:
                    model = PipelineModel([build_model(name, features, params).getStages()[-1].fit(balanced(rows, *counts))])
                else:
                    model = fit(name, rows, features, params, imputed=[f for f in gaps if f not in medians], counts=counts)
                return cut_lineage(score(model, scored).select(
                    id_col, *columns, F.col(C.TARGET).alias("y"), F.col("score").alias("p"), F.lit(name).alias("model")))
            return go

        parts = run_fits([part(n, *cut) for n, cut in enumerate(cuts)], parallelism)
    finally:
        data.unpersist()
    return reduce(DataFrame.unionByName, parts[:k]), reduce(DataFrame.unionByName, parts[k:])


def nested_metrics(oof: DataFrame, inner: DataFrame) -> DataFrame:
    """Per (model, fold), metrics of the out-of-fold scores at the threshold that the inner scores chose."""
    keys = ["model", "fold"]
    thresholds = best_threshold(grid_counts(inner, keys), keys)
    return confusion_at(oof, thresholds, keys).join(ranking_metrics(oof, keys), keys)
