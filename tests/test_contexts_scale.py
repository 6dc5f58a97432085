"""Contexts, answers and nested fits at size: narratives meet claims last, medians of all parts come from one pass."""

import pytest
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import explain as EX
from claimscope.operators import learn as LN
from claimscope.plans import chain_q as CQ

TEXTS = ["no figure", "", None, "  ", "paid 1,299.95 EUR, ref AB12 and 7", 'a "quoted" 4.567\nline \\ 8 € 2024-01-31 \u0001 12', "12 12 12.0"]


def test_numbers_of_a_narrative_are_those_its_context_shows(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    ctx = rows.withColumn("context", F.to_json(F.struct(F.when(F.trim("t") != "", F.col("t")).alias("issue_desc"), F.lit("x").alias("o"))))
    got = EX.with_shown_numbers(ctx, "grounds").withColumn("told", F.coalesce(EX.text_numbers("t"), F.array().cast("array<double>"))).collect()
    assert all(set(r.grounds) == set(r.told) for r in got) and any(r.told for r in got)
    assert [len(r.told) for r in got if r.i == 6] == [1]                                   # each figure once


def test_no_shuffle_carries_narratives(spark, sf, monkeypatch):
    """The plan of d4's contexts shuffles narrow rows only; d16's contexts hold no narrative."""
    narrow = spark.createDataFrame([("CLM-1", 0)], "claim_id string, doc_key long")
    seen = {}

    def joined(spark, sf_dir, d, text=None):
        seen["columns"], seen["text"] = d.columns, text
        raise InterruptedError

    monkeypatch.setattr(CQ, "join_narrative", joined)
    monkeypatch.setattr(CQ, "model_decisions", lambda spark, sf_dir: (narrow, None))
    for narrative, text in ((True, None), (False, EX.text_numbers)):
        with pytest.raises(InterruptedError):
            CQ.model_contexts(spark, sf, narrative)
        assert "issueDesc" not in seen["columns"] and seen["text"] is text


def test_part_facts_are_those_of_each_part(spark):
    rows = [(i % 3, float(i % 7) if i % 4 else None, float("nan") if i % 5 == 0 else float(i), i % 2 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, f"fold int, a double, b double, {C.TARGET} int")
    assert LN.missing_columns(df, ["a", "b", "fold"]) == ["a", "b"]
    facts = LN.part_facts(df, [F.col("fold") != 0, F.col("fold") == 1, F.col("fold") == 9], ["a", "b"])
    for train, (counts, medians) in zip(("fold <> 0", "fold = 1"), facts):
        part = df.where(train)
        assert counts == (part.count(), part.agg(F.sum(C.TARGET)).first()[0])
        pre = LN.Pipeline(stages=LN.imputation(["a", "b"])[0]).fit(part).stages[0].surrogateDF.first()
        assert medians == {"a": pre.a, "b": pre.b}
    assert facts[2] == ((0, 0), {})


def test_only_columns_with_gaps_are_imputed():
    stages, columns = LN.imputation(["a", "b"], ["b"])
    assert stages[0].getInputCols() == ["b"] and columns == ["a", "__i_b"] and LN.imputation(["a"], []) == ([], ["a"])
    assert LN.imputation(["a", "b"])[1] == ["__i_a", "__i_b"]
