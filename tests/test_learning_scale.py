"""Fits at size: class weights are counted once, tree vectors assembled once."""

from claimscope import config as C
from claimscope.operators import learn as LN


def test_class_weights_are_counted_once(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], f"{C.TARGET} int")
    out = LN.with_class_weight(df)
    assert "subquery" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.weight for r in out.collect()) == [4 / 6, 4 / 6, 4 / 6, 2.0]
    assert LN.with_class_weight(df.limit(0)).count() == 0
