"""Call-ledger health: tolerant JSON-lines scan, trailing window, spend, fallbacks, latency (SRC3, SNK1-2, M10-M16, D9/W6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import config as C
from claimscope.operators.evaluate import rnd, safe_div

LEDGER_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("persona", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("latency_ms", T.LongType()), T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()), T.StructField("cost_usd", T.DoubleType()),
    T.StructField("used_fallback_provider", T.BooleanType()),
    T.StructField("used_template_fallback", T.BooleanType()), T.StructField("retried", T.BooleanType()),
    T.StructField("validation_passed", T.BooleanType()), T.StructField("is_mock", T.BooleanType()),
])
DEFAULTS = {"prompt_tokens": 0, "completion_tokens": 0, "cost_usd": 0.0, "used_fallback_provider": False,
            "used_template_fallback": False, "retried": False, "validation_passed": True, "is_mock": False}
FORBIDDEN_LEDGER_COLUMNS = ("prompt", "response", "content", "issue_desc", "issueDesc", "text")


def write_ledger(records: DataFrame, path: str) -> None:
    """SNK1: append one JSON line per call; never any text content (13 facts only)."""
    records.select(*C.LEDGER_FIELDS).write.mode("append").json(path)


def parse_ledger_lines(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """SRC3: JSON lines -> (records, rejected).

    Blank lines are skipped; a line that is not a JSON object, carries an unknown key,
    or lacks a required key is rejected (kept aside with its reason, not dropped silently);
    optional keys take their defaults.
    """
    raw = lines.select(F.col(value_col).alias("line")).where(F.trim("line") != "")
    v = F.try_parse_json("line")
    keys = F.json_object_keys("line")
    known = F.array(*[F.lit(k) for k in C.LEDGER_FIELDS])
    required = F.array(*[F.lit(k) for k in C.LEDGER_REQUIRED_KEYS])
    checked = raw.withColumns({
        "__ok_json": v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
        "__keys": keys})
    reason = (F.when(~F.col("__ok_json"), F.lit("unparsable"))
              .when(F.size(F.array_except("__keys", known)) > 0, F.lit("unknown_key"))
              .when(F.size(F.array_except(required, "__keys")) > 0, F.lit("missing_required_key")))
    checked = checked.withColumn("reason", reason)
    rejected = checked.where(F.col("reason").isNotNull()).select("line", "reason")
    good = checked.where(F.col("reason").isNull()).select(F.from_json("line", LEDGER_SCHEMA).alias("r")).select("r.*")
    return good.fillna(DEFAULTS), rejected


def within_window(records: DataFrame, now: Column, window_hours: int | None = C.DEFAULT_WINDOW_HOURS) -> DataFrame:
    """Keep timestamp >= now - window; None or 0 = no window."""
    ts = F.col("ts") if "ts" in records.columns else F.to_timestamp("timestamp")
    out = records.withColumn("ts", ts)
    if not window_hours:
        return out
    return out.where(F.col("ts") >= now - F.make_interval(hours=F.lit(window_hours)))


def nearest_rank(latencies: DataFrame, keys: list[str], q: float, value: str = "latency_ms") -> DataFrame:
    """Element at round-half-even(q*(n-1)) of the sorted values (0 when empty).

    Grouped by distinct value first: latencies are integer milliseconds, so the
    per-group side is bounded by the latency range, not by the row count.
    """
    counts = latencies.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w_all = Window.partitionBy(*keys)
    cum = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumns({"__n": F.sum("__c").over(w_all), "__cum": F.sum("__c").over(cum)})
    idx = F.least(F.col("__n") - 1, F.bround(F.lit(q) * (F.col("__n") - 1).cast("double"), 0).cast("long"))
    hit = c.where(F.col("__cum") > idx)
    pick = Window.partitionBy(*keys).orderBy(value)
    return (hit.withColumn("__r", F.row_number().over(pick)).where(F.col("__r") == 1)
            .select(*keys, F.col(value).cast("double").alias(f"p{int(round(q * 100))}")))


def status(value: Column, limit: Column) -> Column:
    """>= limit breach, >= 0.8*limit warn, else ok."""
    return (F.when(value >= limit, "breach").when(value >= limit * F.lit(C.WARN_FRACTION), "warn")
            .otherwise("ok"))


def snapshot(records: DataFrame) -> DataFrame:
    """One row of window aggregates (live calls only for cost, tokens and latency)."""
    live = ~F.col("is_mock")
    agg = records.agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(live).alias("n_live"),
        F.coalesce(F.sum(F.when(live, F.col("cost_usd"))), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum(F.when(live, F.col("prompt_tokens") + F.col("completion_tokens"))), F.lit(0))
        .cast("long").alias("total_tokens"),
        F.count_if(F.col("used_fallback_provider")).alias("n_fallback"),
        F.count_if(F.col("used_template_fallback")).alias("n_template"))
    lat = records.where(live).withColumn("__k", F.lit(1))
    p50 = nearest_rank(lat, ["__k"], 0.50)
    p95 = nearest_rank(lat, ["__k"], 0.95)
    out = (agg.withColumn("__k", F.lit(1)).join(p50, "__k", "left").join(p95, "__k", "left").drop("__k"))
    return out.select(
        "n_calls", rnd("total_cost_usd", 4).alias("total_cost_usd"), "total_tokens",
        rnd(F.coalesce("p50", F.lit(0.0)), 1).alias("latency_p50_ms"),
        rnd(F.coalesce("p95", F.lit(0.0)), 1).alias("latency_p95_ms"),
        (F.col("n_live") >= C.MIN_CALLS_FOR_PERCENTILE).alias("latency_confident"),
        "n_live", "n_fallback", "n_template", F.col("total_cost_usd").alias("__cost"),
        F.coalesce("p95", F.lit(0.0)).alias("__p95"))


def thresholds(snap: DataFrame) -> DataFrame:
    """Four named thresholds with value (4 dp), limit and status; healthy = no breach."""
    n = F.greatest(F.col("n_calls"), F.lit(1))
    spend_limit = C.MONTHLY_BUDGET_USD * C.ALERT_AT_BUDGET_FRACTION
    rows = F.array(
        F.struct(F.lit("monthly_spend_usd").alias("name"), F.col("__cost").alias("value"),
                 F.lit(spend_limit).alias("limit")),
        F.struct(F.lit("fallback_rate").alias("name"), safe_div(F.col("n_fallback"), n).alias("value"),
                 F.lit(C.FALLBACK_RATE_ALARM).alias("limit")),
        F.struct(F.lit("template_fallback_rate").alias("name"), safe_div(F.col("n_template"), n).alias("value"),
                 F.lit(C.TEMPLATE_FALLBACK_ALARM).alias("limit")),
        F.struct(F.lit("latency_p95_ms").alias("name"), F.col("__p95").alias("value"),
                 F.lit(C.LATENCY_P95_LIMIT_MS).alias("limit")))
    t = snap.select(F.col("n_live"), F.explode(rows).alias("t")).select("n_live", "t.*")
    st = F.when((F.col("name") == "latency_p95_ms") & (F.col("n_live") < C.MIN_CALLS_FOR_PERCENTILE),
                F.lit("ok")).otherwise(status(F.col("value"), F.col("limit")))
    return t.select("name", rnd("value", 4).alias("value"), "limit", st.alias("status"))


def severity(th: DataFrame) -> DataFrame:
    """A template-fallback breach is an incident; a provider-fallback breach a warning."""
    sev = (F.when((F.col("name") == "template_fallback_rate") & (F.col("status") == "breach"), "incident")
           .when((F.col("name") == "fallback_rate") & (F.col("status") == "breach"), "warning"))
    return th.withColumn("severity", sev)


def privacy_check(ledger: DataFrame, max_len: int = 40) -> DataFrame:
    """No forbidden column, and no string value longer than ``max_len`` characters."""
    strings = [f.name for f in ledger.schema.fields if isinstance(f.dataType, T.StringType)]
    forbidden = [c for c in ledger.columns if c in FORBIDDEN_LEDGER_COLUMNS]
    long_any = F.lit(False)
    for c in strings:
        long_any = long_any | F.coalesce(F.length(c) > max_len, F.lit(False))
    return ledger.agg(F.count_if(long_any).alias("rows_with_long_strings")).withColumn(
        "forbidden_columns", F.lit(len(forbidden)).cast("long"))


def resolve_provider_chain(attempts: DataFrame) -> DataFrame:
    """Per call, first successful provider among those with a key.

    ``attempts``: (call_id, chain_pos, provider, has_key, succeeded). ``attempt`` counts
    tried (keyed) providers up to the winner; fallback = attempt > 1; no success -> failure.
    """
    tried = attempts.where(F.col("has_key"))
    w = Window.partitionBy("call_id").orderBy("chain_pos")
    numbered = tried.withColumn("attempt", F.row_number().over(w))
    first_ok = numbered.where(F.col("succeeded")).groupBy("call_id").agg(
        F.min_by(F.struct("attempt", "provider"), F.col("attempt")).alias("w"))
    calls = attempts.select("call_id").distinct()
    n_tried = tried.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_tried"))
    out = calls.join(first_ok, "call_id", "left").join(n_tried, "call_id", "left")
    return out.select(
        "call_id", F.col("w.provider").alias("provider"),
        F.coalesce(F.col("w.attempt"), F.col("n_tried"), F.lit(0)).cast("int").alias("attempt"),
        F.coalesce(F.col("w.attempt") > 1, F.lit(False)).alias("used_fallback_provider"),
        F.col("w.provider").isNull().alias("failed"))
