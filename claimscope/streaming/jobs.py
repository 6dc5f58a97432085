"""Structured Streaming forms of ingestion, health, routing, drift and throttling.

Each job has a batch twin used as its oracle: run the stream with an
``availableNow`` trigger over the same files and compare with the batch result.
Checkpoints live under the shared checkpoint folder so a restarted job resumes.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from claimscope import config as C
from claimscope.operators import drift as DR
from claimscope.operators import ledger as L


# ------------------------------------------------------------------ T1 ledger ingest

def ingest_ledger(spark: SparkSession, source_dir: str, sink_dir: str, quarantine_dir: str,
                  checkpoint_dir: str):
    """JSON-lines ledger -> typed records sink, bad lines -> quarantine sink (one query)."""
    lines = spark.readStream.format("text").load(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = L.parse_ledger_lines(batch)
        good.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_dir)
        bad.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(quarantine_dir)

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


# ------------------------------------------------------------------ SRC2 claims as JSON lines

CORRUPT = "__corrupt"


def json_claims(lines: DataFrame, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """SRC2: JSON lines -> the typed columns of ``schema`` plus ``outcome`` and ``rejected_fields``; batch or stream.

    The key set is closed. ``outcome`` is the first that holds: ``unparsable`` (no JSON object), ``unknown_field`` (keys outside the
    schema, named), ``wrong_type`` (a value its column cannot hold), ``contract`` (rules of ``contract_violations``, named),
    ``accepted``. Blank lines are skipped.
    """
    names = [f.name for f in schema.fields]
    reader = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = lines.select(F.col(value_col).alias("__line")).where(F.trim("__line") != "")
    is_object = F.try_parse_json("__line").isNotNull() & F.col("__line").rlike(r"^[ \t\r\n]*+\{")     # of what the parser takes, what begins with a brace
    rows = rows.withColumns({"__object": is_object, "__r": F.from_json("__line", reader, {"columnNameOfCorruptRecord": CORRUPT})})
    rows = rows.withColumn("__unknown", F.when(F.col("__object"), F.array_except(F.json_object_keys("__line"), F.array(*[F.lit(n) for n in names]))))
    # a filter on the outcome would be moved below the parser and parse the line again for every field that a rule reads; it does not pass an explode
    rows = rows.select(F.explode_outer(F.array(F.struct("__object", "__unknown", "__r"))).alias("__p")).select("__p.__object", "__p.__unknown", "__p.__r.*")
    broken = contract_violations(rows)
    rows = rows.withColumn("rejected_fields", F.when(~F.col("__object") | F.col(CORRUPT).isNotNull(), F.array().cast("array<string>"))
                           .when(F.size("__unknown") > 0, F.col("__unknown")).otherwise(broken))
    outcome = (F.when(~F.col("__object"), "unparsable").when(F.size("__unknown") > 0, "unknown_field")
               .when(F.col(CORRUPT).isNotNull(), "wrong_type").when(F.size("rejected_fields") > 0, "contract").otherwise("accepted"))
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("rejected_fields", F.when(F.col("outcome") == "unknown_field", F.col("__unknown")).otherwise(F.col("rejected_fields"))).drop(
        "__object", "__unknown", CORRUPT)


def ingest_claims(spark: SparkSession, source_dir: str, schema: T.StructType, accepted_dir: str, quarantine_dir: str, checkpoint_dir: str):
    """SRC2 + T1 as a stream: every line of a micro-batch goes to one of two sinks in the same run.

    A batch writes (over) its own folders, so a batch that is run again after a failure leaves no second copy. The quarantine
    names outcome and fields and holds no submitted value but the claim id (P15).
    """
    lines = spark.readStream.format("text").load(source_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = json_claims(batch, schema)
        ok = F.col("outcome") == "accepted"
        rows.where(ok).drop("outcome", "rejected_fields").write.mode("overwrite").option("compression", "zstd").parquet(f"{accepted_dir}/batch={batch_id}")
        rows.where(~ok).select("claim_id", "outcome", "rejected_fields").write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


# ------------------------------------------------------------------ T2/T3 windowed health

def windowed_health(records: DataFrame, window: str = "1 day", slide: str | None = None,
                    watermark: str = "1 hour") -> DataFrame:
    """Event-time window aggregates of the ledger with a watermark for late records."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    live = ~F.col("is_mock")
    return (records.withWatermark("ts", watermark).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.when(live, F.col("cost_usd")).otherwise(0.0)).alias("cost_usd"),
        F.sum(F.col("used_fallback_provider").cast("long")).alias("n_fallback"),
        F.sum(F.col("used_template_fallback").cast("long")).alias("n_template"))
        .select(F.col("w.start").alias("window_start"), "n_calls", "cost_usd",
                (F.col("n_fallback") / F.col("n_calls")).alias("fallback_rate"),
                (F.col("n_template") / F.col("n_calls")).alias("template_fallback_rate")))


def threshold_alerts(health: DataFrame) -> DataFrame:
    """Windows whose rates breach their limits (appended as alerts)."""
    return health.where((F.col("fallback_rate") >= C.FALLBACK_RATE_ALARM)
                        | (F.col("template_fallback_rate") >= C.TEMPLATE_FALLBACK_ALARM))


def health_stream(records: DataFrame, health_dir: str, alerts_dir: str, checkpoint_dir: str, window: str = "30 days",
                  slide: str = "1 day", watermark: str = "1 hour"):
    """T2 + T3: overlapping event-time windows, written once each when the watermark has passed their end, and the alerts among them.

    State holds one row per open window (window / slide of them), whatever the number of calls. A call whose window is closed no
    longer counts in it. Batches write (over) their own folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{health_dir}/batch={batch_id}")
        threshold_alerts(batch).write.mode("overwrite").parquet(f"{alerts_dir}/batch={batch_id}")

    return (windowed_health(records, window, slide, watermark).writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


# ------------------------------------------------------------------ T8 late and duplicate events

def deduplicate_calls(records: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T8 (our addition): drop redelivered calls within the watermark."""
    return records.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["call_id"])


# ------------------------------------------------------------------ T4 validate -> score -> route

def contract_violations(df: DataFrame) -> F.Column:
    """Names of the rules a claim breaks (empty = valid)."""
    def missing(c):
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    checks = [F.when(missing(c), F.lit(c)) for c in C.REQUIRED_FIELDS if c in df.columns]
    checks += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*vals), F.lit(c))
               for c, vals in C.ENUMS.items() if c in df.columns]
    if "rrp" in df.columns:
        checks.append(F.when(F.col("rrp") <= 0, F.lit("rrp")))
    for c in ("balanceRRP", "excessFee", "oldBalanceRRP"):
        if c in df.columns:
            checks.append(F.when(F.col(c) < 0, F.lit(c)))
    for c in C.CONTRACT_DIAGNOSTICS:
        if c in df.columns:
            checks.append(F.when((F.col(c) < 0) | (F.col(c) > 1), F.lit(c)))
    return F.array_distinct(F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid claims, and a quarantine record that keeps the rule names but no values."""
    v = df.withColumn("rejected_fields", contract_violations(df))
    valid = v.where(F.size("rejected_fields") == 0).drop("rejected_fields")
    keep = [c for c in ("claim_id", "request_id") if c in df.columns]
    rejected = v.where(F.size("rejected_fields") > 0).select(*keep, "rejected_fields")
    return valid, rejected


def route_stream(claims: DataFrame, score_fn) -> DataFrame:
    """T4: contract -> score -> flags -> gate, stateless per micro-batch."""
    from claimscope.operators.decide import risk_flags, route
    valid, _ = split_valid(claims)
    scored = score_fn(valid)
    flagged = scored.withColumn("risk_flags", risk_flags())
    return flagged.withColumn("__g", route(F.col("score"), F.col("risk_flags"))).select(
        "claim_id", "score", "risk_flags", "__g.*")


# ------------------------------------------------------------------ T5 drift per batch

def drift_per_batch(spec: DataFrame, features, report_dir: str, min_rows: int = C.PSI_MIN_ROWS, tag: str | None = None):
    """T5: a foreachBatch function scoring each micro-batch against the frozen reference.

    A batch writes (over) its own folders: a batch run again leaves one report. Under ``min_rows`` rows it leaves a summary with the
    reason and an empty report. ``tag`` names a column whose least value in the batch is carried along.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        n, first = batch.agg(F.count(F.lit(1)), F.min(tag) if tag else F.lit(None).cast("string")).first()
        mark = {tag: F.lit(first)} if tag else {}
        rep = DR.drift_report(spec, batch, features, min_rows=min_rows)
        rep.join(F.broadcast(DR.bin_labels(spec)).withColumnRenamed("bin", "largest_shift_bin"), ["feature", "largest_shift_bin"], "left").withColumns(
            mark).write.mode("overwrite").parquet(f"{report_dir}/features/batch={batch_id}")
        DR.drift_summary(rep, n, min_rows=min_rows).withColumns(mark).write.mode("overwrite").parquet(f"{report_dir}/summary/batch={batch_id}")
    return run


def drift_stream(scored: DataFrame, reference_dir: str, serving_version: str, features, report_dir: str, checkpoint_dir: str,
                 min_rows: int = C.PSI_MIN_ROWS, tag: str | None = None):
    """T5 + M9: the stream of scored claims against the reference of the serving version; refused before it starts if that
    reference is not there or belongs to another version."""
    spec = DR.load_reference(scored.sparkSession, reference_dir, serving_version)
    return (scored.writeStream.foreachBatch(drift_per_batch(spec, features, report_dir, min_rows, tag))
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


# ------------------------------------------------------------------ T6 request throttle

THROTTLE_OUT = ("client string, path string, ts double, request_id long, allowed boolean, "
                "retry_after int, remaining int")


def _decide_one(window: deque, now: float, limit: int, span: float = C.THROTTLE_WINDOW_S):
    while window and now - window[0] > span:
        window.popleft()
    if len(window) >= limit:
        return False, max(int(61.0 - (now - window[0])), 1), 0
    window.append(now)
    return True, 0, max(limit - len(window), 0)


#: Seconds of a time bucket in ``throttle_sessions``; any length is right, it only sets how a hot key is cut up.
SESSION_BUCKET_S = 600.0


def throttle_sessions(requests: DataFrame, span: float = C.THROTTLE_WINDOW_S, bucket: float = SESSION_BUCKET_S) -> DataFrame:
    """Adds ``session``: the time of the last request of the key that came more than ``span`` after the one before it.

    After such a gap all accepted requests are out of the window, so sessions are decided by themselves, and those of a hot key
    in different tasks. Gaps are found per (key, time bucket); what a bucket needs of the earlier ones (its key's last request and
    last gap) comes from a table with one row per key and bucket.
    """
    key = ["client", "path"]
    rows = requests.withColumn("__b", F.floor(F.col("ts") / bucket))
    inside = Window.partitionBy(*key, "__b").orderBy("ts", "request_id")
    rows = rows.withColumn("__prev", F.lag("ts").over(inside))
    gap = F.when(F.col("ts") - F.col("__prev") > span, F.col("ts"))
    ends = rows.groupBy(*key, "__b").agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"), F.max(gap).alias("__gap"))
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__last_before", F.max("__last").over(before))
    opens = F.when(F.col("__last_before").isNull() | (F.col("__first") - F.col("__last_before") > span), F.col("__first"))
    ends = ends.withColumn("__opens", opens).withColumn("__start", F.greatest("__gap", "__opens"))
    ends = ends.withColumn("__enters", F.coalesce("__opens", F.max("__start").over(before)))
    rows = rows.join(ends.select(*key, "__b", "__enters"), [*key, "__b"])
    running = F.max(F.when(F.col("ts") - F.col("__prev") > span, F.col("ts"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session", F.coalesce(running, F.col("__enters"))).drop("__b", "__prev", "__enters")


def throttle_batch(requests: DataFrame, limits: dict = C.THROTTLE_LIMITS) -> DataFrame:
    """T6 batch twin: per (client, path) in time order, exact sliding-60 s decisions.

    The unit of work is a session (``throttle_sessions``), not a client: tasks read sessions sorted by time and keep the at most
    ``limit`` accepted times of the one they are in. A stretch of requests without a pause of 60 s is decided one after the other by nature.
    """
    lim = dict(limits)

    def run(batches):
        current, win = None, deque()
        for pdf in batches:
            out = []
            for client, path, session, ts, rid in zip(pdf["client"], pdf["path"], pdf["session"], pdf["ts"], pdf["request_id"]):
                limit = lim.get(path)
                if limit is None:
                    out.append((client, path, ts, rid, True, 0, None))
                    continue
                if current != (client, path, session):
                    current, win = (client, path, session), deque()
                ok, retry, rem = _decide_one(win, float(ts), limit)
                out.append((client, path, ts, rid, ok, retry, rem))
            yield pd.DataFrame(out, columns=["client", "path", "ts", "request_id", "allowed", "retry_after",
                                             "remaining"]).astype({"remaining": "Int64"})

    ordered = throttle_sessions(requests).repartition("client", "path", "session").sortWithinPartitions(
        "client", "path", "session", "ts", "request_id")
    return ordered.select("client", "path", "session", "ts", "request_id").mapInPandas(run, THROTTLE_OUT)


def throttle_stream(requests: DataFrame, limits: dict = C.THROTTLE_LIMITS, watermark: str | None = None) -> DataFrame:
    """T6 streaming: the accepted times of a key live in state; time order per batch.

    With ``watermark`` (and an ``event_time`` column) a key's state goes when the watermark passes its last accepted request by the
    window's length: then it can no longer bear on a decision.
    """
    lim = dict(limits)
    state_schema = "accepted array<double>"

    def fn(key, pdfs, state):
        client, path = key
        if state.hasTimedOut:
            state.remove()
            return
        win = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(pdfs)).sort_values(["ts", "request_id"])
        limit = lim.get(path)
        out = []
        for ts, rid in zip(rows["ts"], rows["request_id"]):
            if limit is None:
                out.append((client, path, ts, rid, True, 0, None))
                continue
            ok, retry, rem = _decide_one(win, float(ts), limit)
            out.append((client, path, ts, rid, ok, retry, rem))
        if limit is not None:
            state.update((list(win),))
            if watermark and win:
                state.setTimeoutTimestamp(max(int((win[-1] + C.THROTTLE_WINDOW_S) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "path", "ts", "request_id", "allowed", "retry_after",
                                         "remaining"]).astype({"remaining": "Int64"})

    timed = requests.withWatermark("event_time", watermark) if watermark else requests
    return timed.groupBy("client", "path").applyInPandasWithState(
        fn, THROTTLE_OUT, state_schema, "append", GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout)


REQUEST_SCHEMA = T.StructType([T.StructField("client", T.StringType()), T.StructField("path", T.StringType()),
                               T.StructField("ts", T.DoubleType()), T.StructField("request_id", T.LongType())])
