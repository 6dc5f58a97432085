"""Nested cross-validation, candidate families, search with pruning."""

import pytest
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import evaluate as EV
from claimscope.operators import learn as LN
from claimscope.operators import search as SE
from claimscope.plans import learn_q as LQ
from claimscope.session import cut_lineage


@pytest.fixture(scope="module")
def matrix(spark, sf):
    return LQ.fold_matrix(spark, sf, nested=True)


def thresholds(inner):
    keys = ["model", "fold"]
    return {r.fold: r.threshold for r in EV.best_threshold(EV.grid_counts(inner, keys), keys).collect()}


def test_no_row_of_a_fold_reaches_its_threshold(matrix):
    """Fold 0's labels are turned over and its features ruined: its threshold stays, the others' may move."""
    m, feats = matrix
    run = lambda d: LN.nested_scores(d, "logistic_regression", feats, {"maxIter": 5}, parallelism=8)
    oof, inner = run(m)
    spoiled = m.withColumns({C.TARGET: F.when(F.col("fold") == 0, 1 - F.col(C.TARGET)).otherwise(F.col(C.TARGET)),
                             feats[0]: F.when(F.col("fold") == 0, F.lit(1e6)).otherwise(F.col(feats[0]))})
    oof2, inner2 = run(cut_lineage(spoiled))
    a, b = thresholds(inner), thresholds(inner2)
    assert a[0] == b[0] and set(a) == set(range(C.N_FOLDS))
    own = m.select("claim_id", F.col("fold").alias("own"))
    assert inner.join(own, "claim_id").where("own = fold").isEmpty()
    assert inner.groupBy("claim_id", "fold").count().where("count <> 1").isEmpty()
    assert oof.count() == m.count() == oof.select("claim_id").distinct().count()
    got = LN.nested_metrics(cut_lineage(oof), cut_lineage(inner)).collect()
    assert {r.fold: r.threshold for r in got} == a


def test_inner_folds_are_stratified(matrix):
    m, _ = matrix
    sizes = m.select("fold", C.TARGET, F.explode("inner").alias("outer", "inner")).groupBy("outer", C.TARGET, "inner").count().collect()
    by = {}
    for r in sizes:
        by.setdefault((r.outer, r[C.TARGET]), []).append(r["count"])
    assert all(len(v) == C.INNER_FOLDS and max(v) - min(v) <= 1 for v in by.values()) and len(by) == 2 * C.N_FOLDS


def test_imputation_comes_from_the_training_part(spark):
    """A value that only the scored part holds moves nothing; missing values take the training median, trees see -1."""
    train = spark.createDataFrame([(float(i % 5), i % 2) for i in range(40)] + [(None, 1)], f"a double, {C.TARGET} int")
    model = LN.fit("logistic_regression", train, ["a"], {"maxIter": 3})
    scored = LN.score(model, spark.createDataFrame([(None, 0), (2.0, 0)], f"a double, {C.TARGET} int")).collect()
    assert scored[0].score == scored[1].score  # the median of 0..4 is 2
    assert LN.family_inputs(train, "gbt", ["a"]).where("a = -1").count() == 1
    with pytest.raises(ValueError, match="no candidate family"):
        LN.build_model("svm", ["a"])


def test_fits_run_side_by_side_and_raise(spark):
    import threading
    both = threading.Barrier(2, timeout=20)
    assert sorted(LN.run_fits([both.wait, both.wait], 2)) == [0, 1]
    with pytest.raises(ZeroDivisionError):
        LN.run_fits([lambda: 1, lambda: 1 / 0], 2)


def test_median_rule():
    done = [0.5, 0.3, 0.4, 0.2, 0.6]
    assert SE.prunes(0.39, 2, done) and not SE.prunes(0.4, 2, done)       # below, at the median
    assert not SE.prunes(0.1, 1, done) and not SE.prunes(0.1, 4, done[:4])  # warm-up, start-up
    assert SE.prunes(0.44, 3, [*done, 0.6]) and not SE.prunes(0.45, 3, [*done, 0.6])  # even number: the two middle ones' mean


def test_replay_of_a_recorded_study(spark):
    """A table written by hand: pruned trials do not count, a trial that completes later does not count, the best mean does."""
    rows, seq = [], 0

    def trial(t, values, state):
        nonlocal seq
        for step, v in enumerate(values):
            seq += 1
            rows.append((t, "{}", step, seq, v, max(values[: step + 1]), 0, None, state if step == len(values) - 1 else SE.RUNNING))

    for t in range(5):
        trial(t, [0.5, 0.5, 0.5, 0.5, 0.5], SE.COMPLETE)
    trial(5, [0.1, 0.1, 0.1], SE.PRUNED)
    trial(6, [0.6, 0.1, 0.1, 0.1, 0.1], SE.COMPLETE)     # its best mean stays over the median
    trial(7, [0.1, 0.1, 0.1, 0.1, 0.1], SE.COMPLETE)     # wrong: should have stopped at step 2
    events = spark.createDataFrame(rows, SE.EVENTS)
    bad = SE.replay(events).where("not agrees").collect()
    assert {(r.trial, r.step, r.expected) for r in bad} == {(7, s, SE.PRUNED) for s in (2, 3, 4)}
    assert SE.best_trial(events).first().trial == 0


def test_search_stops_trials_and_restarts(spark, sf, matrix, tmp_path, monkeypatch):
    m, feats = matrix
    at = f"file://{tmp_path}/study"
    first = SE.search(m, "logistic_regression", feats, at, n_trials=7, parallelism=4)
    assert SE.replay(first).where("not agrees").isEmpty() and SE.trials(first).count() == 7
    calls = []
    real = LN.fit
    monkeypatch.setattr(LN, "fit", lambda *a, **k: calls.append(1) or real(*a, **k))
    more = SE.search(m, "logistic_regression", feats, at, n_trials=8, parallelism=2)
    assert 3 <= len(calls) <= C.N_FOLDS                                   # only the new trial was fitted
    assert SE.trials(more).count() == 8 and SE.replay(more).where("not agrees").isEmpty()
    assert {r.trial: r.mean_pr_auc for r in SE.trials(first).collect()}.items() <= {r.trial: r.mean_pr_auc for r in SE.trials(more).collect()}.items()
    assert SE.draw("gbt", 3) == SE.draw("gbt", 3) != SE.draw("gbt", 4)


def test_prepared_part_fits_as_the_pipeline_does(matrix):
    """One preparation per fold serves every setting and changes no score."""
    m, feats = matrix
    train, held = m.where("fold <> 0"), m.where("fold = 0")
    part = LN.prepare("logistic_regression", train, held, feats)
    for params in ({"C": 0.01, "maxIter": 5}, {"C": 5.0, "maxIter": 5}):
        whole = LN.score(LN.fit("logistic_regression", train, feats, params), held).agg(F.sum("score"), F.sum(F.col("score") ** 2)).first()
        shared = LN.score(LN.fit("logistic_regression", part, feats, params), part.held).agg(F.sum("score"), F.sum(F.col("score") ** 2)).first()
        assert list(shared) == pytest.approx(list(whole), rel=1e-9)


def test_search_prepares_each_fold_once(matrix, tmp_path, monkeypatch):
    m, feats = matrix
    made = []
    prepare = LN.prepare
    monkeypatch.setattr(LN, "prepare", lambda *a: made.append(1) or prepare(*a))
    SE.search(m, "logistic_regression", feats, str(tmp_path / "study"), n_trials=2, n_folds=3, parallelism=2, fixed={"maxIter": 2})
    assert len(made) == 3
