"""Ledger queries over a call ledger derived from ``events`` (SRC3, SNK1, M10-M16, D9/W6, T2 batch twin)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import ledger as L
from claimscope.plans.registry import query, with_ctes
from claimscope.session import ensure_checkpoint_dir
from claimscope.sources.tables import read_table

# (column, SQL) valid in Spark SQL and DuckDB; one ledger record per event.
LEDGER_EXPRS = [
    ("call_id", "event_id"),
    ("ts", "ts"),
    ("persona", "CASE user_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'adjuster' ELSE 'auditor' END"),
    ("provider", "CASE event_type WHEN 'view' THEN 'groq' WHEN 'click' THEN 'groq_reserve_2' "
                 "WHEN 'signup' THEN 'openai' WHEN 'purchase' THEN 'gemini' ELSE 'template' END"),
    ("model", "CASE event_type WHEN 'signup' THEN 'gpt-4o-mini' WHEN 'purchase' THEN 'gemini-2.0-flash' "
              "WHEN 'error' THEN 'template' ELSE 'llama-3.3-70b' END"),
    ("latency_ms", "CAST(floor(value * 20) AS BIGINT)"),
    ("prompt_tokens", "CAST(event_id % 1000 AS BIGINT)"),
    ("completion_tokens", "CAST(event_id % 200 AS BIGINT)"),
    ("cost_usd", "CAST(event_id % 1000 + event_id % 200 AS DOUBLE) * CAST(0.000001 AS DOUBLE)"),
    ("used_fallback_provider", "event_type = 'error'"),
    ("used_template_fallback", "event_id % 101 = 0"),
    ("retried", "event_id % 7 = 0"),
    ("validation_passed", "event_id % 13 <> 0"),
    ("is_mock", "event_id % 10 = 0"),
]
CHAIN = ("groq", "groq_reserve_2", "groq_reserve_3", "openai", "gemini")


def ledger_records(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return ev.selectExpr(*[f"{e} AS {n}" for n, e in LEDGER_EXPRS])


def now_col(spark, sf_dir):
    """"Now" is the newest event, so windows are reproducible (scalar subquery)."""
    return read_table(spark, sf_dir, "events", ["ts"]).select(F.max("ts")).scalar()


def windowed(spark, sf_dir, hours=C.DEFAULT_WINDOW_HOURS):
    return L.within_window(ledger_records(spark, sf_dir), now_col(spark, sf_dir), hours)


LEDGER_SQL = "ledger AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LEDGER_EXPRS) + " FROM events)"
WIN_SQL = ("win AS (SELECT * FROM ledger WHERE ts >= (SELECT max(ts) FROM events) - "
           f"INTERVAL {C.DEFAULT_WINDOW_HOURS} HOUR)")


def _nr_sql(q, src, keys=""):
    by = f"PARTITION BY {keys}" if keys else ""
    kcol = f"{keys}, " if keys else ""
    return (f"SELECT {kcol}CAST(min(latency_ms) AS DOUBLE) AS v FROM (SELECT {kcol}latency_ms, "
            f"sum(c) OVER ({by} ORDER BY latency_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
            f"sum(c) OVER ({by}) AS n FROM (SELECT {kcol}latency_ms, count(*) AS c FROM {src} GROUP BY ALL)) "
            f"WHERE cum > least(n - 1, CAST(round_even(CAST({q} AS DOUBLE) * CAST(n - 1 AS DOUBLE), 0) AS BIGINT))"
            + (f" GROUP BY {keys}" if keys else ""))


def _r(x, d):
    s = float(10 ** d)
    return f"floor(({x}) * {s} + 0.5) / {s}"


SNAP_SQL = f"""snap AS (
  SELECT count(*) AS n_calls, count_if(NOT is_mock) AS n_live,
    coalesce(sum(CASE WHEN NOT is_mock THEN cost_usd END), CAST(0 AS DOUBLE)) AS cost,
    CAST(coalesce(sum(CASE WHEN NOT is_mock THEN prompt_tokens + completion_tokens END), 0) AS BIGINT) AS total_tokens,
    count_if(used_fallback_provider) AS n_fallback, count_if(used_template_fallback) AS n_template,
    coalesce(({_nr_sql(0.5, "(SELECT * FROM win WHERE NOT is_mock)")}), CAST(0 AS DOUBLE)) AS p50,
    coalesce(({_nr_sql(0.95, "(SELECT * FROM win WHERE NOT is_mock)")}), CAST(0 AS DOUBLE)) AS p95
  FROM win)"""


def _status_sql(v, lim):
    return (f"CASE WHEN {v} >= {lim} THEN 'breach' WHEN {v} >= {lim} * {C.WARN_FRACTION} THEN 'warn' ELSE 'ok' END")


_SPEND = C.MONTHLY_BUDGET_USD * C.ALERT_AT_BUDGET_FRACTION
TH_SQL = f"""th AS (
  SELECT 'monthly_spend_usd' AS name, cost AS value, CAST({_SPEND} AS DOUBLE) AS lim, n_live FROM snap
  UNION ALL SELECT 'fallback_rate', n_fallback / CAST(greatest(n_calls, 1) AS DOUBLE), CAST({C.FALLBACK_RATE_ALARM} AS DOUBLE), n_live FROM snap
  UNION ALL SELECT 'template_fallback_rate', n_template / CAST(greatest(n_calls, 1) AS DOUBLE), CAST({C.TEMPLATE_FALLBACK_ALARM} AS DOUBLE), n_live FROM snap
  UNION ALL SELECT 'latency_p95_ms', p95, CAST({C.LATENCY_P95_LIMIT_MS} AS DOUBLE), n_live FROM snap),
thr AS (
  SELECT name, {_r('value', 4)} AS value, lim AS "limit",
    CASE WHEN name = 'latency_p95_ms' AND n_live < {C.MIN_CALLS_FOR_PERCENTILE} THEN 'ok' ELSE {_status_sql('value', 'lim')} END AS status
  FROM th)"""
LEDGER_CTES = (LEDGER_SQL, WIN_SQL, SNAP_SQL, TH_SQL)


@query("m10_ledger_snapshot", with_ctes(*LEDGER_CTES)(
    f"SELECT n_calls, {_r('cost', 4)} AS total_cost_usd, total_tokens, {_r('p50', 1)} AS latency_p50_ms, "
    f"{_r('p95', 1)} AS latency_p95_ms, n_live >= {C.MIN_CALLS_FOR_PERCENTILE} AS latency_confident FROM snap"))
def m10_ledger_snapshot(spark, sf_dir):
    s = L.snapshot(windowed(spark, sf_dir))
    return s.select("n_calls", "total_cost_usd", "total_tokens", "latency_p50_ms", "latency_p95_ms",
                    "latency_confident")


@query("m11_latency_by_persona", with_ctes(LEDGER_SQL, WIN_SQL)(
    "SELECT a.persona, a.v AS p50, b.v AS p95 FROM (" + _nr_sql(0.5, "(SELECT * FROM win WHERE NOT is_mock)", "persona")
    + ") a JOIN (" + _nr_sql(0.95, "(SELECT * FROM win WHERE NOT is_mock)", "persona") + ") b ON a.persona = b.persona"))
def m11_latency_by_persona(spark, sf_dir):
    live = windowed(spark, sf_dir).where(~F.col("is_mock"))
    return L.nearest_rank(live, ["persona"], 0.5).join(L.nearest_rank(live, ["persona"], 0.95), "persona")


@query("m12_calls_by_provider", with_ctes(LEDGER_SQL, WIN_SQL)(
    "SELECT provider, count(*) AS n FROM win GROUP BY provider"))
def m12_calls_by_provider(spark, sf_dir):
    return windowed(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("m13_thresholds", with_ctes(*LEDGER_CTES)('SELECT name, value, "limit", status FROM thr'))
def m13_thresholds(spark, sf_dir):
    return L.thresholds(L.snapshot(windowed(spark, sf_dir)))


@query("m16_incident_severity", with_ctes(*LEDGER_CTES)(
    "SELECT name, value, \"limit\", status, CASE WHEN name = 'template_fallback_rate' AND status = 'breach' "
    "THEN 'incident' WHEN name = 'fallback_rate' AND status = 'breach' THEN 'warning' END AS severity FROM thr"))
def m16_incident_severity(spark, sf_dir):
    return L.severity(L.thresholds(L.snapshot(windowed(spark, sf_dir))))


_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"


@query("m15_ledger_privacy", with_ctes(LEDGER_SQL)(
    "SELECT count_if(length(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00')) > 40 OR length(persona) > 40 "
    "OR length(provider) > 40 OR length(model) > 40) AS rows_with_long_strings, CAST(0 AS BIGINT) AS forbidden_columns "
    "FROM ledger"))
def m15_ledger_privacy(spark, sf_dir):
    rec = ledger_records(spark, sf_dir).withColumn("timestamp", F.date_format("ts", _ISO)).drop("ts")
    return L.privacy_check(rec.select(*C.LEDGER_FIELDS))


@query("t2_daily_health", with_ctes(LEDGER_SQL)(
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n_calls, "
    + _r("coalesce(sum(CASE WHEN NOT is_mock THEN cost_usd END), 0)", 4) + " AS cost_usd, "
    + _r("count_if(used_fallback_provider) / CAST(count(*) AS DOUBLE)", 6) + " AS fallback_rate FROM ledger GROUP BY 1"))
def t2_daily_health(spark, sf_dir):
    """T2 batch twin: tumbling one-day event-time windows of ledger health."""
    rec = ledger_records(spark, sf_dir)
    g = rec.groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.coalesce(F.sum(F.when(~F.col("is_mock"), F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
        (F.count_if("used_fallback_provider") / F.count(F.lit(1))).alias("fallback_rate"))
    from claimscope.operators.evaluate import rnd
    return g.select(F.col("w.start").alias("window_start"), "n_calls", rnd("cost_usd", 4).alias("cost_usd"),
                    rnd("fallback_rate", 6).alias("fallback_rate"))


def attempts(spark, sf_dir):
    """Recorded provider attempts: every event tries the five-provider chain."""
    ev = read_table(spark, sf_dir, "events", ["event_id"])
    chain = F.array(*[F.lit(p) for p in CHAIN])
    return (ev.select(F.col("event_id").alias("call_id"), F.posexplode(chain).alias("pos0", "provider"))
            .select("call_id", (F.col("pos0") + 1).alias("chain_pos"), "provider")
            .withColumns({"has_key": (F.col("call_id") + F.col("chain_pos")) % 5 != 0,
                          "succeeded": (F.col("call_id") + 2 * F.col("chain_pos")) % 3 == 0}))


_CHAIN_VALUES = ", ".join(f"({i + 1}, '{p}')" for i, p in enumerate(CHAIN))


@query("d9_provider_chain", (
    "WITH att AS (SELECT e.event_id AS call_id, c.pos AS chain_pos, c.provider, "
    "(e.event_id + c.pos) % 5 <> 0 AS has_key, (e.event_id + 2 * c.pos) % 3 = 0 AS succeeded "
    f"FROM events e CROSS JOIN (VALUES {_CHAIN_VALUES}) c(pos, provider)), "
    "tried AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY chain_pos) AS attempt FROM att WHERE has_key), "
    "win AS (SELECT call_id, arg_min(provider, attempt) AS provider, min(attempt) AS attempt FROM tried WHERE succeeded GROUP BY call_id), "
    "nt AS (SELECT call_id, count(*) AS n_tried FROM tried GROUP BY call_id) "
    "SELECT c.call_id, w.provider, CAST(coalesce(w.attempt, nt.n_tried, 0) AS INTEGER) AS attempt, "
    "coalesce(w.attempt > 1, false) AS used_fallback_provider, w.provider IS NULL AS failed "
    "FROM (SELECT DISTINCT call_id FROM att) c LEFT JOIN win w ON w.call_id = c.call_id LEFT JOIN nt ON nt.call_id = c.call_id"))
def d9_provider_chain(spark, sf_dir):
    return L.resolve_provider_chain(attempts(spark, sf_dir))


@query("src3_ledger_roundtrip", with_ctes(LEDGER_SQL)(
    "SELECT persona, provider, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM ledger GROUP BY ALL"))
def src3_ledger_roundtrip(spark, sf_dir):
    """SNK1 + SRC3: write the ledger as JSON lines (plus corrupt lines), read back tolerantly."""
    path = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rec = ledger_records(spark, sf_dir).withColumn("timestamp", F.date_format("ts", _ISO))
    L.write_ledger(rec, path)
    bad = rec.where(F.col("call_id") % 997 == 0).select(
        F.concat(F.lit('{"timestamp": "'), F.col("timestamp")).alias("value"))  # truncated JSON
    unknown = rec.where(F.col("call_id") % 991 == 0).select(
        F.to_json(F.struct(*C.LEDGER_FIELDS, F.lit("x").alias("prompt"))).alias("value"))
    bad.unionByName(unknown).write.mode("append").text(path)
    good, _rejected = L.parse_ledger_lines(spark.read.text(path))
    return good.groupBy("persona", "provider").agg(F.count(F.lit(1)).alias("n"),
                                                   F.sum("latency_ms").cast("long").alias("latency_ms"))
