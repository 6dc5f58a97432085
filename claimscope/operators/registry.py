"""Model registry on shared storage: immutable versions with cards, an alias table that moves, scoring pinned to the card (SNK5, SNK6, P11, O4).

Layout below a root folder: ``models/<id>`` a saved ``PipelineModel``; ``cards/<version>`` one row, written last, so a version that
is listed is whole; ``aliases/<n>`` the whole alias table after its n-th change. Numbers are claimed by creating their
folder: of two writers one fails on the existing folder and takes the next number. Nothing is ever rewritten.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators.evaluate import rnd

PRODUCTION = "production"
CARD = ("version int, algorithm string, threshold double, feature_names array<string>, metrics map<string,double>, n_training_rows long, "
        "trained_at string, git_commit string, model_path string")
ALIASES = "alias string, version int, change int"
CARD_METRICS = ("f1_declined", "recall_declined", "precision_declined", "roc_auc", "pr_auc", "brier")


@dataclass
class ModelCard:
    """What serving needs to know of a version: its threshold and the features in the order it was fitted with."""

    version: int
    algorithm: str
    threshold: float
    feature_names: list[str]
    metrics: dict[str, float]
    n_training_rows: int
    trained_at: str
    git_commit: str = "unknown"
    model_path: str = field(default="", repr=False)


def _table(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(pattern)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _claim(first: int, write) -> int:
    """The first number from ``first`` on whose folder ``write(number)`` can create."""
    for n in range(first, first + 1000):
        try:
            write(n)
            return n
        except AnalysisException as taken:
            if taken.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise RuntimeError("the registry is written by too many at once")


def cards(spark: SparkSession, root: str) -> DataFrame:
    """All registered versions, one card each."""
    return _table(spark, f"{root}/cards/*", CARD)


def register(model: PipelineModel, root: str, algorithm: str, feature_names, folds: DataFrame, n_training_rows: int,
             git_commit: str = "unknown", trained_at: str | None = None) -> ModelCard:
    """SNK5: save ``model`` as the next version; threshold and metrics are the means over ``folds`` (``nested_metrics``), 4 decimals."""
    spark = folds.sparkSession
    means = folds.agg(rnd(F.avg("threshold"), 4).alias("threshold"), *[rnd(F.avg(m), 4).alias(m) for m in CARD_METRICS]).first()
    path = f"{root}/models/{uuid.uuid4().hex}"
    model.save(path)
    card = ModelCard(0, algorithm, means["threshold"], list(feature_names), {m: means[m] for m in CARD_METRICS}, n_training_rows,
                     trained_at or datetime.now(timezone.utc).isoformat(timespec="seconds"), git_commit, path)

    def write(n: int) -> None:
        card.version = n
        spark.createDataFrame([asdict(card)], CARD).coalesce(1).write.mode("error").parquet(f"{root}/cards/{n:05d}")

    last = cards(spark, root).agg(F.max("version")).first()[0] or 0
    _claim(last + 1, write)
    return card


def alias_table(spark: SparkSession, root: str) -> DataFrame:
    """The current alias table: the last one written."""
    tables = _table(spark, f"{root}/aliases/*", ALIASES)
    return tables.where(F.col("change") == tables.agg(F.max("change")).first()[0]).select("alias", "version")


def promote(spark: SparkSession, root: str, version: int, alias: str = PRODUCTION) -> None:
    """SNK6: point ``alias`` at ``version``; it leaves the version that held it. The alias table is rewritten as a new one."""
    if cards(spark, root).where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is not registered")

    def write(n: int) -> None:
        held = [(r.alias, r.version) for r in alias_table(spark, root).collect() if r.alias != alias]
        rows = [(*pair, n) for pair in [*held, (alias, version)]]
        spark.createDataFrame(rows, ALIASES).coalesce(1).write.mode("error").parquet(f"{root}/aliases/{n:05d}")

    last = _table(spark, f"{root}/aliases/*", ALIASES).agg(F.max("change")).first()[0] or 0
    _claim(last + 1, write)


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """Versions with their aliases (comma-joined), newest first."""
    held = alias_table(spark, root).groupBy("version").agg(F.array_join(F.array_sort(F.collect_list("alias")), ",").alias("aliases"))
    return cards(spark, root).join(held, "version", "left").select(
        "version", "algorithm", F.coalesce("aliases", F.lit("")).alias("aliases"), "threshold", F.col("metrics")["f1_declined"].alias("f1_declined"),
        "trained_at").orderBy(F.col("version").desc())


def load(spark: SparkSession, root: str, alias: str = PRODUCTION) -> tuple[PipelineModel, ModelCard]:
    """The model and card that ``alias`` (or a version number) stands for; an error if there is none."""
    version = int(alias) if str(alias).isdigit() else next(
        (r.version for r in alias_table(spark, root).where(F.col("alias") == alias).collect()), None)
    row = cards(spark, root).where(F.col("version") == version).first() if version else None
    if row is None:
        raise LookupError(f"no registered version stands under {alias!r}")
    card = ModelCard(**row.asDict())
    return PipelineModel.load(card.model_path), card


def pinned(df: DataFrame, card: ModelCard, keep=("claim_id",)) -> DataFrame:
    """The card's features in the card's order after the ``keep`` columns; others go, a missing one is an error before any job runs."""
    missing = [f for f in card.feature_names if f not in df.columns]
    if missing:
        raise ValueError(f"version {card.version} needs features that are not there: {', '.join(missing)}")
    return df.select(*keep, *card.feature_names)
