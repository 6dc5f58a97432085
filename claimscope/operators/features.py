"""Feature derivation and encoding into the model matrix.

``FeatureEncoder.fit`` learns the frequency and ordinal maps in one aggregation
pass (unpivot the 11 categorical columns, one partial-aggregated groupBy); the
maps are small per-level tables joined back by broadcast only under a checked
row count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import config as C
from claimscope.functions.parsing import parse_product_name
from claimscope.functions.text import char_length, word_count
from claimscope.session import cut_lineage, lookup_join

MAX_LITERAL_LEVELS = 256  # a map is searched key by key; columns of more fitted levels are joined (checked broadcast) instead
NULL_LEVEL = "nan"  # a null category is one text level on both fit and serve sides


def from_product_name(df: DataFrame) -> DataFrame:
    """parsed signals; a stated device type wins unless UNKNOWN."""
    if "productName" not in df.columns:
        return df
    p = parse_product_name("productName")
    parsed = df.withColumn("__p", p)
    if "deviceType" in df.columns:
        stated = F.when(F.col("deviceType") != F.lit(C.CATEGORICAL_FILL), F.col("deviceType"))
        device = F.coalesce(stated, F.col("__p.device_type_parsed"), F.lit(C.CATEGORICAL_FILL))
    else:
        device = F.coalesce(F.col("__p.device_type_parsed"), F.lit(C.CATEGORICAL_FILL))
    return parsed.withColumns({
        "deviceType": device,
        "is_mandatory_policy": F.coalesce((F.col("__p.policy_class") == "MANDATORY").cast("int"),
                                          F.lit(0)),
        "policy_class": F.coalesce(F.col("__p.policy_class"), F.lit(C.DEFAULT_POLICY_CLASS)),
        "payment_mode": F.coalesce(F.col("__p.payment_mode"), F.lit(C.CATEGORICAL_FILL)),
        "contract_duration_months": F.coalesce(F.col("__p.contract_duration_months").cast("double"),
                                               F.lit(float(C.DEFAULT_DURATION_MONTHS))),
    }).drop("__p", "productName")


def _finite(c):
    return F.when(F.abs(c) == F.lit(float("inf")), F.lit(None)).otherwise(c)


def ratios(df: DataFrame, eps: float = C.RATIO_EPS) -> DataFrame:
    """currency-invariant ratios; +-inf -> null."""
    out = df
    den = F.col("rrp") + F.lit(eps)
    if {"excessFee", "rrp"} <= set(df.columns):
        out = out.withColumn("fee_to_rrp_ratio", _finite(F.try_divide(F.col("excessFee"), den)))
    if {"balanceRRP", "rrp"} <= set(df.columns):
        out = out.withColumns({
            "balance_ratio": _finite(F.try_divide(F.col("balanceRRP"), den)),
            "remaining_balance_ratio": _finite(F.try_divide(F.col("rrp") - F.col("balanceRRP"), den)),
        })
    return out


def _days_between(later, earlier):
    micros = F.unix_micros(F.col(later)) - F.unix_micros(F.col(earlier))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def date_features(df: DataFrame) -> DataFrame:
    """whole-day intervals (floored), start month and year; raw dates dropped."""
    cols = set(df.columns)
    out = df
    if {"policyStartDate", "policyEndDate"} <= cols:
        out = out.withColumns({
            "policy_duration_days": _days_between("policyEndDate", "policyStartDate"),
            "policy_start_month": F.month("policyStartDate").cast("long"),
            "policy_start_year": F.year("policyStartDate").cast("long"),
        })
    if {"purchaseDate", "policyStartDate"} <= cols:
        out = out.withColumn("days_purchase_to_policy",
                             _days_between("policyStartDate", "purchaseDate"))
    return out.drop("policyStartDate", "policyEndDate", "purchaseDate")


def diagnostic_meta(df: DataFrame, columns=C.DIAGNOSTIC_COLUMNS,
                    sentinel: int = C.DIAGNOSTIC_SENTINEL) -> DataFrame:
    """how many checks ran, and how many returned 1 and 0 (counted apart)."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return df

    def count(pred):
        return sum((F.coalesce(pred(F.col(c)), F.lit(False)).cast("long") for c in cols), F.lit(0))

    return df.withColumns({
        "diag_completeness": count(lambda c: c != F.lit(sentinel)),
        "diag_ones": count(lambda c: c == F.lit(1)),
        "diag_zeros": count(lambda c: c == F.lit(0)),
    })


def text_meta(df: DataFrame) -> DataFrame:
    """narrative length and word count, note presence; the text itself leaves."""
    out = df
    if "issueDesc" in df.columns:
        out = out.withColumns({"issue_desc_length": char_length("issueDesc"),
                               "issue_desc_word_count": word_count("issueDesc")})
    if "other" in df.columns:
        out = out.withColumn("has_other_notes", F.col("other").isNotNull().cast("int"))
    return out.drop(*C.HOLD_OUT_TEXT)


def derive(df: DataFrame) -> DataFrame:
    return text_meta(diagnostic_meta(date_features(ratios(from_product_name(df)))))


def ordinal_columns(df: DataFrame) -> list[str]:
    return [c for c in dict.fromkeys(C.LABEL_ENCODED + C.EXTRA_ORDINAL) if c in df.columns]


def level_of(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL))


def fit_levels(derived: DataFrame) -> DataFrame:
    """One pass over the data: (column, level, n) for every encoded column."""
    freq = [c for c in C.FREQUENCY_ENCODED if c in derived.columns]
    cols = list(dict.fromkeys(freq + ordinal_columns(derived)))
    long = derived.select(*[level_of(c).alias(c) for c in cols]).unpivot(
        [], cols, "column", "level")
    return long.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def _from_map(mapping: dict | None, c: str):
    if not mapping:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv]), level_of(c))


@dataclass
class EncoderModel:
    """Fitted maps: frequency share per level and ordinal index per level."""

    frequency: DataFrame  # column, level, share
    ordinal: DataFrame    # column, level, idx
    n_frequency: int
    n_ordinal: int
    keep_absolute_amounts: bool = True
    feature_names: list[str] = field(default_factory=list)

    def encode(self, df: DataFrame) -> DataFrame:
        """Each column by the number of its own levels: few become a literal map (as a fitted indexer keeps its labels), more are
        joined, by broadcast below a checked number, so that no column of few levels is ever shuffled by them."""
        columns = {f"{c}_freq": (self.frequency, "share", c, F.lit(0.0), "double") for c in C.FREQUENCY_ENCODED if c in df.columns}
        columns |= {c: (self.ordinal, "idx", c, F.lit(-1), "int") for c in ordinal_columns(df)}
        out, literal = df, {}
        sizes, known = {}, {}
        for fitted, value in ((self.frequency, "share"), (self.ordinal, "idx")):
            sizes[value] = {r["column"]: r["count"] for r in fitted.groupBy("column").count().collect()}   # one row per encoded column
            few = [c for c, n in sizes[value].items() if n <= MAX_LITERAL_LEVELS]
            for r in fitted.where(F.col("column").isin(*few)).collect() if few else []:
                known.setdefault((value, r["column"]), {})[r["level"]] = r[value]
        for name, (fitted, value, c, absent, kind) in columns.items():
            n = sizes[value].get(c, 0)
            if n <= MAX_LITERAL_LEVELS:
                literal[name] = F.coalesce(_from_map(known.get((value, c)), c).cast(kind), absent).cast(kind)
                continue
            lk = fitted.where(F.col("column") == c).select(F.col("level").alias("__lvl"), F.col(value).alias("__v"))
            out = lookup_join(out, lk, level_of(c) == F.col("__lvl"), known_rows=n)
            out = out.withColumn(name, F.coalesce(F.col("__v").cast(kind), absent).cast(kind)).drop("__lvl", "__v")
        return out.withColumns(literal).drop(*[c for c in C.FREQUENCY_ENCODED if c in df.columns])

    def finalise(self, df: DataFrame, keep=("claim_id",), target: str = C.TARGET) -> DataFrame:
        """Drop non-features and leftovers, optional amounts; sorted by name, target last."""
        ids = [c for c in keep if c in df.columns]
        drop = set(C.NON_FEATURE_COLUMNS) | {"claim_key", "doc_key"}
        if not self.keep_absolute_amounts:
            drop |= set(C.ABSOLUTE_AMOUNTS)
        numeric = (T.NumericType,)
        feats = sorted(f.name for f in df.schema.fields
                       if f.name not in drop and f.name not in ids and f.name != target
                       and isinstance(f.dataType, numeric) and not isinstance(f.dataType, T.BooleanType))
        tail = [target] if target in df.columns else []
        self.feature_names = feats
        return df.select(*ids, *feats, *tail)

    def transform(self, cleaned: DataFrame, keep=("claim_id",)) -> DataFrame:
        return self.finalise(self.encode(derive(cleaned)), keep=keep)

    def save(self, path: str) -> None:
        """SNK4: both maps in one Parquet table."""
        f = self.frequency.select("column", "level", F.col("share").alias("value"), F.lit("frequency").alias("kind"))
        o = self.ordinal.select("column", "level", F.col("idx").cast("double").alias("value"), F.lit("ordinal").alias("kind"))
        f.unionByName(o).coalesce(1).write.mode("overwrite").parquet(f"{path}/encoder")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncoderModel:
        t = spark.read.parquet(f"{path}/encoder").cache()
        freq = t.where(F.col("kind") == "frequency").select("column", "level", F.col("value").alias("share"))
        ordi = t.where(F.col("kind") == "ordinal").select("column", "level", F.col("value").cast("int").alias("idx"))
        return cls(freq, ordi, freq.count(), ordi.count())


class FeatureEncoder:
    """F7/F8 fit: frequency share and code-point-sorted ordinal index per level."""

    def __init__(self, keep_absolute_amounts: bool = True):
        self.keep_absolute_amounts = keep_absolute_amounts

    def fit(self, cleaned: DataFrame) -> EncoderModel:
        derived = derive(cleaned)
        levels = cut_lineage(fit_levels(derived))                  # one row per column and level
        # Every encoded column sees every row, so one column's level counts sum to the total.
        first = levels.select(F.min("column")).scalar()
        total = levels.where(F.col("column") == first).select(F.sum("n")).scalar()
        freq = cut_lineage(levels.where(F.col("column").isin(*C.FREQUENCY_ENCODED))
                           .select("column", "level", (F.col("n") / total).alias("share")))
        by_col = Window.partitionBy("column").orderBy("level")
        ordi = cut_lineage(levels.where(F.col("column").isin(*ordinal_columns(derived)))
                           .select("column", "level", (F.dense_rank().over(by_col) - 1).cast("int").alias("idx")))
        return EncoderModel(freq, ordi, freq.count(), ordi.count(), self.keep_absolute_amounts)
