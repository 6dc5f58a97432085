"""Claims are dealt into tasks by their number; texts are worked on once per document."""

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions.text import repair_mojibake
from claimscope.operators import clean as CL
from claimscope.operators import explain as EX
from claimscope.sources import claims as SC


def test_claims_are_dealt_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(C, "CLAIMS_PER_TASK", 50)
    tasks = SC.claim_tasks(spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert tasks == -(-orders // 50) > spark.sparkContext.defaultParallelism
    for raw in (SC.raw_claims(spark, sf, with_text=False), SC.raw_claims(spark, sf)):
        assert raw.select("claim_id").rdd.getNumPartitions() == tasks


def test_dealing_keeps_parallelism_for_few_claims(spark, sf):
    assert SC.raw_claims(spark, sf, with_text=False).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_texts_repaired_per_document_are_those_repaired_per_claim(spark):
    rows = spark.createDataFrame([("a", "SkÃ¤rm", "plain"), ("b", None, None), ("c", "cafÃ© �", "Ã¤"), ("d", "plain", "")],
                                 "claim_id string, issueDesc string, other string")
    before = CL.text_for_review(rows)
    after = CL.text_for_review(rows.withColumn("issueDesc", repair_mojibake("issueDesc")), repaired=("issueDesc",))
    assert sorted(before.collect()) == sorted(after.collect())
    assert {r.claim_id: r.issue_desc for r in after.collect()}["a"] == "Skärm"


def test_grounds_derived_once_give_the_same_issues(spark):
    rows = spark.createDataFrame([
        ("customer", '{"summary": "A fee of 98765 EUR.", "key_factors": ["x"], "next_steps": ["y"]}', '{"a": 5}'),
        ("adjuster", '```json\n{"summary": "Worth 120.4 EUR, \\u0034\\u0032", "key_factors": [], "risk_assessment": 0}\n```', '{"rrp": 120.37, "t": "no \\u0034\\u0032"}'),
        ("auditor", "no JSON", None), (None, '{"summary": "77"}', None)], "persona string, response string, context string")
    rows = rows.withColumns({"requires_human_review": F.lit(True), "is_declined": F.lit(False)})
    plain = EX.validate(rows).select("persona", "issues")
    once = EX.validate(EX.with_shown_numbers(rows, "grounds"), allowed_col="grounds").select("persona", "issues")
    assert sorted(map(str, plain.collect())) == sorted(map(str, once.collect()))
