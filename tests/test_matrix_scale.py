"""The feature matrix at size: the joins kept once, dear expressions only where they can matter, small levels never joined."""

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions import parsing as PA
from claimscope.functions import text as TX
from claimscope.operators import features as FE
from claimscope.plans import common as PC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_fit_reads_the_kept_base(spark, sf):
    raw = PC.claims_for_features(spark, sf)
    assert "InMemoryTableScan" in plan_of(PC.fitted_cleaner(raw).transform(raw).select("productCode"))
    raw.sparkSession.catalog.clearCache()


def test_only_columns_of_many_levels_are_joined(spark, monkeypatch):
    rows = [(f"m{i}", f"p{i % 3}", None if i % 4 == 0 else "r", ["NL", "SE"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "model string, productCode string, retailerName string, country string")
    enc = FE.FeatureEncoder().fit(df)
    want = sorted(map(str, enc.encode(df).collect()))
    monkeypatch.setattr(FE, "MAX_LITERAL_LEVELS", 10)
    got = enc.encode(df)
    assert plan_of(got).count("Join") == 1 and got.columns == enc.encode(df).columns
    by_name = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    monkeypatch.setattr(FE, "MAX_LITERAL_LEVELS", 100)
    assert by_name(got) == by_name(enc.encode(df)) and len(want) == 40


def test_texts_that_no_pass_decodes_are_left_out_of_the_passes(spark):
    texts = ["plain", "é", "aé", "éa", "Ã¤", "SkÃ¤rm", "Ã", "xÃ", "Ã¤ é", "â€™", "café Ã¶", "¤Ã", "ðŸ˜€", "😀", "é\n", "", "ÃƒÂ¤", "ô\u0090", "õ€€€", "Ãé", "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    passes = lambda c: F.aggregate(F.sequence(F.lit(1), F.lit(3)), c, lambda acc, _: TX._cp1252_utf8_pass(acc))
    rows = df.select("t", TX.repair_mojibake("t").alias("now"), passes(F.col("t")).alias("all"), F.rlike("t", F.lit(TX.NO_MOJIBAKE_REGEX)).alias("left")).collect()
    assert all(r.now == r["all"] for r in rows) and all(r["all"] == r.t for r in rows if r.left)
    left = {r.t for r in rows if r.left}
    assert {"é", "aé", "éa", "Ã", "é\n"} <= left and not left & {"Ã¤", "SkÃ¤rm", "â€™", "plain"}


def test_dates_are_tried_by_their_separators(spark):
    texts = ["2020-01-05 10:11:12", "2020-01-05", "5/1/2020", "05/01/2020", "5-1-2020", "31/13/2020", "unknown", " 2020-02-30 ", "1:2-3", "1/2-3",
             "2020-01-05T10:11:12", "", None, "+12020-01-05", "-2020-01-05", "1/2/-2020", "1-2--2020", "2020-01-05 10:11", "1/2/2020 10:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in PA.DATE_FORMATS])
    rows = df.select("t", PA.parse_mixed_date("t").cast("string").alias("now"), plain.cast("string").alias("all")).collect()
    assert all(r.now == r["all"] for r in rows) and sum(r.now is not None for r in rows) >= 5
    plan = plan_of(df.select(PA.parse_mixed_date("t").alias("d")))
    assert plan.lower().count("contains(") >= len(PA.DATE_FORMATS)


def test_product_names_are_cut_once(spark):
    df = spark.createDataFrame([("NL_MANDATORY_ADLD_24M_MONTHLY_ tablets ",), ("",), (None,), ("  ",), ("x",)], "n string")
    got = df.select(PA.parse_product_name("n").alias("p"))
    assert plan_of(got).count("split(") == 1
    rows = got.select("p", "p.*").collect()
    assert all(r.p is not None for r in rows) and rows[0].policy_class == "MANDATORY" and rows[0].contract_duration_months == 24
    assert all(v is None for r in rows[1:] for v in r[1:])


def test_a_limit_of_the_session_stays(spark):
    from claimscope.session import compiled_in_parts
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "65535")
        compiled_in_parts(spark)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "9000")
        compiled_in_parts(spark)
        assert spark.conf.get(key) == "9000"
    finally:
        spark.conf.set(key, before)
