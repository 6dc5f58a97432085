"""Fits side by side: each keeps its own query ids; a search finds class counts and medians of all its folds in one pass."""

import threading

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import learn as LN
from claimscope.operators import search as SE


def test_tasks_side_by_side_have_their_own_local_properties(spark):
    """They shared one object, so a task's query ids were taken away by another's and its query failed."""
    both = threading.Barrier(2, timeout=60)

    def task(name):
        def go():
            both.wait()
            spark.sparkContext.setLocalProperty("claimscope.task", name)
            both.wait()
            return spark.sparkContext.getLocalProperty("claimscope.task")
        return go

    assert LN.run_fits([task("a"), task("b")], 2) == ["a", "b"]


def test_search_finds_facts_of_all_folds_once(spark, tmp_path, monkeypatch):
    rows = [(f"c{i}", i % 3, int(i % 4 == 0), float(i % 7), None if i % 5 == 0 else float(i % 11)) for i in range(240)]
    df = spark.createDataFrame(rows, f"claim_id string, fold int, {C.TARGET} int, a double, b double").cache()
    calls = {"facts": 0, "gaps": 0}
    facts, gaps = LN.part_facts, LN.missing_columns
    monkeypatch.setattr(LN, "part_facts", lambda *a: calls.__setitem__("facts", calls["facts"] + 1) or facts(*a))
    monkeypatch.setattr(LN, "missing_columns", lambda *a: calls.__setitem__("gaps", calls["gaps"] + 1) or gaps(*a))
    got = SE.trials(SE.search(df, "logistic_regression", ["a", "b"], str(tmp_path / "study"), n_trials=1, n_folds=3, fixed={"maxIter": 3})).collect()
    assert calls == {"facts": 1, "gaps": 1} and got[0].folds_run == 3
    values = []
    for k in range(3):
        train, held = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        s = LN.score(LN.fit("logistic_regression", train, ["a", "b"], {**SE.draw("logistic_regression", 0), "maxIter": 3}), held)
        values.append(SE.ranking_metrics(s.select(F.lit("m").alias("model"), F.col(C.TARGET).alias("y"), F.col("score").alias("p")), ["model"]).first()["pr_auc"])
    assert abs(got[0].mean_pr_auc - sum(values) / 3) < 1e-9
