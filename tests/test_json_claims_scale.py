"""A stream of claims as JSON at size: each line is parsed once for its fields, whatever is asked of its outcome."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.operators import decide as DE
from claimscope.streaming import jobs as J

SCHEMA = T.StructType([T.StructField("claim_id", T.StringType()), T.StructField("rrp", T.DoubleType()), T.StructField("country", T.StringType())])


def test_a_filter_on_the_outcome_does_not_parse_again(spark):
    lines = spark.range(3).select(F.concat(F.lit('{"claim_id": "'), "id", F.lit('"}')).alias("value"))
    ok = J.json_claims(lines, SCHEMA).where(F.col("outcome") == "accepted").drop("outcome", "rejected_fields")
    assert ok._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_only_objects_are_objects(spark):
    texts = [' {"claim_id": "1"} ', '\t{"claim_id": "1"}', '[{"claim_id": "1"}]', '"{"', "1", "null", "true", "{", '{"a": 1}', "{}", '{"claim_id": "1"', "{{}}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    got = [J.json_claims(rows.where(F.col("i") == i), SCHEMA).first().outcome for i in range(len(texts))]
    assert [x == "unparsable" for x in got] == [False, False, True, True, True, True, True, True, False, False, True, True]
    assert got[8] == "unknown_field"


def test_claim_fields_are_derived_before_the_personas(spark):
    d = DE.with_claim_fields(spark.sql("SELECT " + ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in DE.C.TECHNICAL_SUMMARY_FIELDS)))
    assert len(d.columns) == len(DE.C.TECHNICAL_SUMMARY_FIELDS) + 2 and len(DE.without_claim_fields(d).columns) == len(DE.C.TECHNICAL_SUMMARY_FIELDS)
