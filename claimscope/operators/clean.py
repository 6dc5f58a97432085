"""Cleaning: make the raw claim extract correct.

Every step is a column expression over the whole table, tolerant of absent
columns, so a partial frame (one JSON request, a stream micro-batch) cleans the
same way as the training table. The fitted state (median excess per product
code, global median) is learned once by ``ClaimCleaner.fit`` and reused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions.parsing import parse_mixed_date, to_number
from claimscope.functions.text import has_mojibake, repair_mojibake
from claimscope.session import cut_lineage, lookup_join


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def repair_text(df: DataFrame, columns=C.TEXT_COLUMNS) -> DataFrame:
    """P8 applied to the text columns that exist."""
    return df.withColumns({c: repair_mojibake(c) for c in columns if c in df.columns})


def mojibake_counts(df: DataFrame, columns=C.TEXT_COLUMNS) -> DataFrame:
    """Per text column, values showing corruption markers before and after repair."""
    cols = [c for c in columns if c in df.columns]
    aggs = []
    for c in cols:
        aggs.append(F.count_if(has_mojibake(c)).alias(f"{c}__before"))
        aggs.append(F.count_if(has_mojibake(repair_mojibake(c))).alias(f"{c}__after"))
    wide = df.agg(*aggs)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__before").alias("corrupted_before"),
                 F.col(f"{c}__after").alias("corrupted_after")) for c in cols])).alias("s"))
    return stacked.select("s.*").withColumn(
        "rows_fixed", F.col("corrupted_before") - F.col("corrupted_after"))


def normalise_currency(df: DataFrame, rate: float = C.SEK_TO_EUR,
                       sek_countries=C.SEK_COUNTRIES, columns=C.AMOUNT_COLUMNS) -> DataFrame:
    """SEK amounts to EUR; ``currency_original`` records what was filed."""
    amounts = [c for c in columns if c in df.columns]
    if "country" not in df.columns or not amounts:
        return df
    if "oldBalanceRRP" in df.columns:
        amounts.append("oldBalanceRRP")
    in_sek = F.coalesce(F.col("country").isin(*sek_countries), F.lit(False))
    out = df.withColumns({c: F.when(in_sek, F.col(c) / F.lit(rate)).otherwise(F.col(c))
                          for c in amounts})
    return out.withColumn("currency_original", F.when(in_sek, "SEK").otherwise("EUR"))


def columns_to_drop(df: DataFrame) -> list[str]:
    wanted = C.DROP_CONSTANT + C.DROP_DUPLICATE + C.DROP_DEGENERATE + C.DROP_REDUNDANT_TEXT
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def drop_columns(df: DataFrame) -> DataFrame:
    """Constant, duplicate, degenerate and redundant-text columns."""
    return df.drop(*columns_to_drop(df))


def parse_dates(df: DataFrame, columns=C.DATE_COLUMNS) -> DataFrame:
    """ISO and day-first text to timestamps; unparsable -> null."""
    return df.withColumns({c: parse_mixed_date(c) for c in columns if c in df.columns})


def unparsed_date_counts(raw: DataFrame, columns=C.DATE_COLUMNS) -> DataFrame:
    """P3 report: per date column, non-null text that failed to parse."""
    cols = [c for c in columns if c in raw.columns]
    wide = raw.agg(*[F.count_if(F.col(c).isNotNull() & parse_mixed_date(c).isNull()).alias(c)
                     for c in cols])
    return wide.unpivot([], cols, "column", "unparsed")


def fix_anomalies(df: DataFrame) -> DataFrame:
    """A non-positive price or a negative balance is missing, not a value."""
    out = df
    if "rrp" in df.columns:
        out = out.withColumn("rrp", F.when(F.col("rrp") <= 0, F.lit(None)).otherwise(F.col("rrp")))
    if "balanceRRP" in df.columns:
        out = out.withColumn("balanceRRP", F.when(F.col("balanceRRP") < 0, F.lit(None))
                             .otherwise(F.col("balanceRRP")))
    return out


def anomaly_counts(df: DataFrame) -> DataFrame:
    """P4 report (after currency normalisation)."""
    return df.agg(F.count_if(F.col("rrp") <= 0).alias("rrp_non_positive"),
                  F.count_if(F.col("balanceRRP") < 0).alias("balance_negative"))


def flag_diagnostics(df: DataFrame, columns=C.DIAGNOSTIC_COLUMNS,
                     sentinel: int = C.DIAGNOSTIC_SENTINEL) -> DataFrame:
    """P5: number or null -> -1 "never assessed", truncated to int."""
    return df.withColumns({
        c: F.coalesce(to_number(c), F.lit(float(sentinel))).cast("int")
        for c in columns if c in df.columns})


def fill_categoricals(df: DataFrame, columns=C.CATEGORICAL_COLUMNS,
                      fill: str = C.CATEGORICAL_FILL) -> DataFrame:
    """Missing category is its own level, not the mode."""
    return df.fillna({c: fill for c in columns if c in df.columns})


def encode_target(df: DataFrame, target: str = C.TARGET,
                  positive: str = C.POSITIVE_CLASS) -> DataFrame:
    """Declined -> 1, anything else (null too) -> 0."""
    if target not in df.columns:
        return df
    return df.withColumn(target, F.coalesce((F.col(target) == positive).cast("int"), F.lit(0)))


def text_for_review(df: DataFrame, repaired=()) -> DataFrame:
    """P10: repaired narrative and notes for the explanation layer, null -> ''.

    ``repaired`` names columns that were repaired before they were joined (once per document).
    """
    text = lambda c: F.coalesce(F.col(c) if c in repaired else repair_mojibake(c), F.lit(""))
    return df.select(*[c for c in ("claim_id",) if c in df.columns], text("issueDesc").alias("issue_desc"), text("other").alias("other"))


@dataclass
class CleanerModel:
    """Fitted imputation state: one row per product code plus the global median."""

    medians: DataFrame
    n_medians: int
    global_median: float | None
    rate: float = C.SEK_TO_EUR
    dropped: list[str] = field(default_factory=list)

    def impute_numeric(self, df: DataFrame) -> DataFrame:
        """missing fee -> product median -> global median (fit values only)."""
        if "excessFee" not in df.columns:
            return df
        if "productCode" not in df.columns:
            return df.withColumn("excessFee", F.coalesce("excessFee", F.lit(self.global_median)))
        lk = self.medians.select(F.col("productCode").alias("__pc"), "excess_fee_median")
        joined = lookup_join(df, lk, df["productCode"] == lk["__pc"], known_rows=self.n_medians)
        fee = F.coalesce(F.col("excessFee"), F.col("excess_fee_median"),
                         F.lit(self.global_median).cast("double"))
        return joined.withColumn("excessFee", fee).drop("__pc", "excess_fee_median")

    def transform(self, raw: DataFrame) -> DataFrame:
        out = repair_text(raw)
        out = normalise_currency(out, rate=self.rate)
        self.dropped = columns_to_drop(out)
        out = drop_columns(out)
        out = parse_dates(out)
        out = fix_anomalies(out)
        out = flag_diagnostics(out)
        out = fill_categoricals(out)
        out = self.impute_numeric(out)
        return encode_target(out)

    def save(self, path: str) -> None:
        """SNK4: fitted state as a small Parquet table beside the model."""
        g = F.lit(self.global_median).cast("double")
        (self.medians.withColumn("global_median", g).withColumn("rate", F.lit(self.rate))
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/cleaner"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CleanerModel:
        t = spark.read.parquet(f"{path}/cleaner").cache()
        first = t.select("global_median", "rate").limit(1).collect()
        gm, rate = (first[0][0], first[0][1]) if first else (None, C.SEK_TO_EUR)
        medians = t.where(F.col("productCode").isNotNull()).select("productCode", "excess_fee_median")
        return cls(medians, medians.count(), gm, rate)


class ClaimCleaner:
    """learn per-product and global median excess after repair and FX."""

    def __init__(self, rate: float = C.SEK_TO_EUR):
        self.rate = rate

    def fit(self, raw: DataFrame) -> CleanerModel:
        work = normalise_currency(repair_text(raw.select(
            *[c for c in ("excessFee", "productCode", "country") if c in raw.columns])),
            rate=self.rate)
        # One pass: per-code medians and the grand median via a rollup.
        rolled = cut_lineage(work.rollup("productCode")
                             .agg(F.percentile("excessFee", 0.5).alias("excess_fee_median"),
                                  F.grouping("productCode").alias("g")))
        medians = rolled.where((F.col("g") == 0) & F.col("productCode").isNotNull()
                               & F.col("excess_fee_median").isNotNull()
                               ).select("productCode", "excess_fee_median")
        total = rolled.where(F.col("g") == 1).select("excess_fee_median").collect()
        gm = total[0][0] if total else None
        return CleanerModel(medians, medians.count(), gm, self.rate)


def fit_medians_table(raw: DataFrame, rate: float = C.SEK_TO_EUR) -> DataFrame:
    """F9 as a table: product code (null = global) and its median excess."""
    work = normalise_currency(repair_text(raw.select("excessFee", "productCode", "country")), rate=rate)
    rolled = work.rollup("productCode").agg(
        F.percentile("excessFee", 0.5).alias("excess_fee_median"),
        F.grouping("productCode").alias("is_global"))
    return rolled.where((F.col("is_global") == 1) | (F.col("productCode").isNotNull()
                                                    & F.col("excess_fee_median").isNotNull()))
