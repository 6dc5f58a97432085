"""Ledger, validation, SHAP and streaming twins."""

import tempfile

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import explain as EX
from claimscope.operators import ledger as L


def test_ledger_parse_rejects_bad_lines(spark):
    good = '{"timestamp": "2026-01-01T00:00:00+00:00", "persona": "customer", "provider": "groq", "model": "m", "latency_ms": 5}'
    lines = [good, "", "not json", '{"persona": "x"}', good.replace('"latency_ms": 5', '"latency_ms": 5, "prompt": "x"')]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    recs, bad = L.parse_ledger_lines(df)
    assert recs.count() == 1 and bad.count() == 3
    r = recs.collect()[0]
    assert r.cost_usd == 0.0 and r.validation_passed is True and r.is_mock is False


def test_nearest_rank_round_half_even(spark):
    df = spark.createDataFrame([(v,) for v in [10, 20, 30, 40]], "latency_ms long").withColumn("k", F.lit(1))
    # index round(0.5 * 3) = round(1.5) = 2 -> 30
    assert L.nearest_rank(df, ["k"], 0.5).collect()[0].p50 == 30.0


def test_validator_catches_each_rejection(spark):
    cases = [
        ("customer", '{"summary": "Your claim was declined.", "key_factors": ["a"], "next_steps": ["b"]}', False,
         "sentiment_consistency"),
        ("customer", '{"summary": "The probability is low.", "key_factors": ["a"], "next_steps": ["b"]}', False,
         "customer_leakage"),
        ("adjuster", '```json\n{"summary": "ok", "key_factors": ["a"], "risk_assessment": "r"}\n```', False, "schema"),
        ("auditor", "nonsense", False, "json_parse"),
        ("customer", '{"summary": "An expert will assess it soon.", "key_factors": ["a"], "next_steps": ["b"]}',
         False, "sentiment_consistency"),
    ]
    df = spark.createDataFrame([(p, t, r, False, '{"rrp": 100.0}') for p, t, r, _ in cases],
                               "persona string, response string, requires_human_review boolean, is_declined boolean, context string")
    got = [r.failed_checks for r in EX.summary(EX.validate(df)).collect()]
    assert [c for *_, c in cases] == got


def test_shap_additivity_on_smoke_data(spark, sf):
    from claimscope.plans.learn_q import x11_shap_additivity
    r = x11_shap_additivity(spark, sf).collect()[0]
    assert r.n_claims > 0 and r.violations == 0


def test_throttle_stream_equals_batch(spark, sf):
    from claimscope.plans.stream_q import requests
    from claimscope.streaming import jobs as J
    limits = {"/api/v1/predict": 5, "/api/v1/explain": 2}
    req = requests(spark, sf)
    src = tempfile.mkdtemp(prefix="throttle-src-")
    req.write.mode("overwrite").parquet(src)
    batch = J.throttle_batch(req, limits).select("request_id", "allowed", "retry_after").collect()
    stream = spark.readStream.schema(J.REQUEST_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(src)
    q = (J.throttle_stream(stream, limits).writeStream.format("memory").queryName("thr")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="thr-ckpt-")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT request_id, allowed, retry_after FROM thr").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert any(not r.allowed for r in batch)


def test_ledger_stream_ingest_quarantines(spark, sf):
    from claimscope.plans.ledger_q import ledger_records
    from claimscope.streaming import jobs as J
    src = tempfile.mkdtemp(prefix="ledger-src-")
    rec = ledger_records(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    L.write_ledger(rec, src)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(src)
    sink, bad, ck = (tempfile.mkdtemp(prefix=p) for p in ("sink-", "bad-", "ck-"))
    J.ingest_ledger(spark, src, sink, bad, ck).awaitTermination()
    assert spark.read.parquet(sink).count() == rec.count()
    assert spark.read.parquet(bad).count() == 1


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0 and "decline_rate" in out.columns
