"""Queries over raw, cleaned and engineered claims (SRC1, P1-P12, P17, F1-F11, A1-A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions.parsing import parse_product_name
from claimscope.functions.text import has_mojibake, repair_mojibake
from claimscope.operators import clean as CL
from claimscope.operators import quality as Q
from claimscope.operators.features import FeatureEncoder
from claimscope.plans.common import (claims_for_features, cleaned_claims, feature_matrix, spread,
                                     fitted_cleaner, round_doubles, ts_text)
from claimscope.plans.registry import query, with_ctes
from claimscope.plans.sql_claims import (CLEAN_CTES, CURRENCY, FEATURE_CTES, FEATURE_NAMES,
                                         MEDIANS, PARSED, _date, r6)
from claimscope.sources.claims import claims_sql, raw_claims
from claimscope.sources.tables import read_table

RAW_COLS = ("claim_id",) + C.EXPECTED_COLUMNS
CLAIMS = claims_sql()
CLAIMS_NT = claims_sql(with_text=False)
_PARSED_RAW = PARSED.replace("FROM cleaned", "FROM claims")
_STRIP = "regexp_replace({x}, 'S+$', '')"
_AGREE = (f"coalesce({_STRIP.format(x='upper(deviceType)')} = {_STRIP.format(x='device_type_parsed')}, false)")

# ----------------------------------------------------------------------------- SRC1


@query("src1_claims_raw", with_ctes(CLAIMS)(f"SELECT {', '.join(RAW_COLS)} FROM claims"))
def src1_claims_raw(spark, sf_dir):
    return raw_claims(spark, sf_dir).select(*RAW_COLS)


# ----------------------------------------------------------------------------- P1-P7

@query("p1_normalise_currency", with_ctes(CLAIMS_NT, CURRENCY)(
    f"SELECT claim_id, {r6('rrp')} AS rrp, {r6('excessFee')} AS excessFee, "
    f"{r6('balanceRRP')} AS balanceRRP, {r6('oldBalanceRRP')} AS oldBalanceRRP, currency_original FROM cur"))
def p1_normalise_currency(spark, sf_dir):
    out = CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False))
    return round_doubles(out.select("claim_id", "rrp", "excessFee", "balanceRRP", "oldBalanceRRP",
                                    "currency_original"))


def _dates_sql():
    return ", ".join(f"strftime({_date(c)}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in C.DATE_COLUMNS)


@query("p3_parse_dates", with_ctes(CLAIMS_NT)(f"SELECT claim_id, {_dates_sql()} FROM claims"))
def p3_parse_dates(spark, sf_dir):
    out = CL.parse_dates(raw_claims(spark, sf_dir, with_text=False))
    return out.select("claim_id", *[ts_text(c).alias(c) for c in C.DATE_COLUMNS])


@query("p3_unparsed_date_counts", with_ctes(CLAIMS_NT)(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count_if({c} IS NOT NULL AND {_date(c)} IS NULL) AS unparsed FROM claims"
    for c in C.DATE_COLUMNS)))
def p3_unparsed_date_counts(spark, sf_dir):
    return CL.unparsed_date_counts(raw_claims(spark, sf_dir, with_text=False))


@query("p4_anomaly_counts", with_ctes(CLAIMS_NT, CURRENCY)(
    "SELECT count_if(rrp <= 0) AS rrp_non_positive, count_if(balanceRRP < 0) AS balance_negative FROM cur"))
def p4_anomaly_counts(spark, sf_dir):
    return CL.anomaly_counts(CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False)))


_diag_cols = ", ".join(C.DIAGNOSTIC_COLUMNS)


@query("p5_flag_diagnostics", with_ctes(*CLEAN_CTES)(f"SELECT claim_id, {_diag_cols} FROM cleaned"))
def p5_flag_diagnostics(spark, sf_dir):
    return CL.flag_diagnostics(raw_claims(spark, sf_dir, with_text=False)).select(
        "claim_id", *C.DIAGNOSTIC_COLUMNS)


CLEANED_OUT = ("claim_id", "excessFee", "rrp", "balanceRRP", "productName", "coverage", "productCode",
               "policyStatus", "retailerName", "deviceType", "model", "channel", "claimType", "country",
               "status") + C.DIAGNOSTIC_COLUMNS + ("other", "currency_original")


def _cleaned_sql():
    cols = ", ".join(r6(c) + f" AS {c}" if c in ("excessFee", "rrp", "balanceRRP") else c for c in CLEANED_OUT)
    dates = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in C.DATE_COLUMNS)
    return with_ctes(*CLEAN_CTES)(f"SELECT {cols}, {dates} FROM cleaned")


@query("p_cleaned_claims", _cleaned_sql())
def p_cleaned_claims(spark, sf_dir):
    """P1-P7 + F10 in order; the absent dropped columns (P2) are part of the schema check."""
    out = cleaned_claims(spark, sf_dir, with_text=False)
    return round_doubles(out.select(*CLEANED_OUT, *[ts_text(c).alias(c) for c in C.DATE_COLUMNS]))


@query("p9_mojibake_counts", with_ctes(CLAIMS)(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count_if(coalesce(regexp_matches({c}, 'Ã[^\\n]|Â[^\\n]|â€'), false)) AS corrupted "
    f"FROM claims" for c in C.TEXT_COLUMNS)))
def p9_mojibake_counts(spark, sf_dir):
    raw = raw_claims(spark, sf_dir)
    wide = raw.agg(*[F.count_if(has_mojibake(c)).alias(c) for c in C.TEXT_COLUMNS])
    return wide.unpivot([], list(C.TEXT_COLUMNS), "column", "corrupted")


@query("p10_text_for_review", with_ctes(CLAIMS)(
    "SELECT claim_id, coalesce(issueDesc, '') AS issue_desc, coalesce(other, '') AS other FROM claims"))
def p10_text_for_review(spark, sf_dir):
    return CL.text_for_review(raw_claims(spark, sf_dir, text=repair_mojibake), repaired=("issueDesc",))


@query("p17_claim_id_default", with_ctes(CLAIMS_NT)(
    "SELECT claim_key, coalesce(CASE WHEN claim_key % 10 = 0 THEN NULL ELSE claim_id END, "
    "'CLM-' || upper(substr(md5(CAST(claim_key AS VARCHAR)), 1, 8))) AS claim_id FROM claims"))
def p17_claim_id_default(spark, sf_dir):
    from claimscope.operators.decide import default_claim_id
    raw = raw_claims(spark, sf_dir, with_text=False)
    given = F.when(F.col("claim_key") % 10 == 0, F.lit(None)).otherwise(F.col("claim_id"))
    return raw.select("claim_key", default_claim_id(given, F.col("claim_key").cast("string")).alias("claim_id"))


# ----------------------------------------------------------------------------- F1-F11

@query("f1_parse_product_name", with_ctes(CLAIMS_NT, _PARSED_RAW)(
    "SELECT claim_id, productName, device_type_parsed, payment_parsed AS payment_mode, "
    "CAST(duration_parsed AS INTEGER) AS contract_duration_months, class_parsed AS policy_class FROM parsed"))
def f1_parse_product_name(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False)
    return raw.select("claim_id", "productName", parse_product_name("productName").alias("p")).select(
        "claim_id", "productName", "p.*")


@query("f9_fee_medians", with_ctes(CLAIMS_NT, CURRENCY, MEDIANS)(
    f"SELECT productCode, {r6('excess_fee_median')} AS excess_fee_median, 0 AS is_global FROM fee_medians "
    f"UNION ALL SELECT NULL, {r6('gm')}, 1 FROM fee_global"))
def f9_fee_medians(spark, sf_dir):
    t = CL.fit_medians_table(raw_claims(spark, sf_dir, with_text=False))
    return round_doubles(t.select("productCode", "excess_fee_median", F.col("is_global").cast("int")))


@query("f7_frequency_map", with_ctes(*FEATURE_CTES)(f"SELECT col AS column, level, {r6('share')} AS share FROM freq"))
def f7_frequency_map(spark, sf_dir):
    raw = claims_for_features(spark, sf_dir)
    enc = FeatureEncoder().fit(fitted_cleaner(raw).transform(raw))
    return round_doubles(enc.frequency)


@query("f8_ordinal_levels", with_ctes(*FEATURE_CTES)("SELECT col AS column, level, idx FROM ord"))
def f8_ordinal_levels(spark, sf_dir):
    raw = claims_for_features(spark, sf_dir)
    return FeatureEncoder().fit(fitted_cleaner(raw).transform(raw)).ordinal


def _matrix_sql(names):
    cols = ", ".join(r6(n) + f" AS {n}" if n in DOUBLE_FEATURES else n for n in names)
    return with_ctes(*FEATURE_CTES)(f"SELECT claim_id, {cols}, status FROM matrix")


DOUBLE_FEATURES = {"balanceRRP", "excessFee", "rrp", "balance_ratio", "fee_to_rrp_ratio",
                   "remaining_balance_ratio", "contract_duration_months", "model_freq",
                   "productCode_freq", "retailerName_freq"}


@query("f_feature_matrix", _matrix_sql(FEATURE_NAMES))
def f_feature_matrix(spark, sf_dir):
    """The 37-feature matrix, sorted by name, target last."""
    m, _ = feature_matrix(spark, sf_dir, keep=("claim_id",))
    return round_doubles(m)


@query("f11_matrix_without_amounts", _matrix_sql([n for n in FEATURE_NAMES if n not in C.ABSOLUTE_AMOUNTS]))
def f11_matrix_without_amounts(spark, sf_dir):
    raw = claims_for_features(spark, sf_dir)
    cleaned = fitted_cleaner(raw).transform(raw)
    enc = FeatureEncoder(keep_absolute_amounts=False).fit(cleaned)
    return round_doubles(enc.transform(cleaned, keep=("claim_id",)))


# ----------------------------------------------------------------------------- A1-A12

@query("a1_profile_dataset", with_ctes(CLAIMS_NT)(
    "SELECT status AS target_class, count(*) AS n, sum(count(*)) OVER () AS n_rows, "
    f"CAST({len(RAW_COLS) + 1} AS BIGINT) AS n_cols, "
    "max(count(*)) OVER () / greatest(min(count(*)) OVER (), 1) AS imbalance_ratio FROM claims GROUP BY status"))
def a1_profile_dataset(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False)
    return Q.profile_dataset(raw).withColumn("n_rows", F.col("n_rows").cast("long"))


@query("a2_missingness_report", with_ctes(CLAIMS)(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_unique, "
    f"round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM claims" for c in RAW_COLS)))
def a2_missingness_report(spark, sf_dir):
    """A2 over every raw column; the narrative is counted by its digest, taken once per document, so that no text is shuffled."""
    raw = raw_claims(spark, sf_dir, with_text=False)
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"])).select(F.col("doc_id").alias("__doc"), F.md5("text").alias("issueDesc"))
    return Q.missingness_report(raw.join(docs, raw["doc_key"] == docs["__doc"], "left"), RAW_COLS)


def _a3_sql():
    def med(a, ctry):
        return f"quantile_cont({a}, 0.5) FILTER (WHERE country = '{ctry}')"
    parts = [
        f"SELECT '{a}' AS amount, {r6(med(a, 'SE'))} AS median_se, {r6(med(a, 'NL'))} AS median_nl, "
        f"{r6(med(a, 'FI'))} AS median_fi, "
        f"{r6(med(a, 'SE') + ' / ((' + med(a, 'NL') + ' + ' + med(a, 'FI') + ') / 2)')} AS implied_rate FROM claims"
        for a in C.AMOUNT_COLUMNS]
    return with_ctes(CLAIMS_NT)(" UNION ALL ".join(parts))


@query("a3_country_medians", _a3_sql())
def a3_country_medians(spark, sf_dir):
    return round_doubles(Q.country_medians(raw_claims(spark, sf_dir, with_text=False)))


_A4_COLS = ("country", "claimType", "policyStatus", "coverage", "channel")


@query("a4_decline_rate_by_category", with_ctes(CLAIMS_NT)(
    "SELECT col AS column, level, " + r6("avg(y)") + " AS decline_rate, count(*) AS n, count(*) < 50 AS thin_cell, "
    + r6("(SELECT avg(CASE WHEN status = 'Declined' THEN 1 ELSE 0 END) FROM claims)") + " AS overall_rate FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS level, "
                         f"CASE WHEN status = 'Declined' THEN 1 ELSE 0 END AS y FROM claims" for c in _A4_COLS)
    + ") GROUP BY col, level"))
def a4_decline_rate_by_category(spark, sf_dir):
    return round_doubles(Q.decline_rate_by_category(raw_claims(spark, sf_dir, with_text=False), _A4_COLS))


@query("a5_parse_coverage", with_ctes(CLAIMS_NT, _PARSED_RAW)(
    "SELECT " + ", ".join(f"{r6(f'avg(CAST({cond} AS DOUBLE)) * 100.0')} AS {name}" for cond, name in [
        ("device_type_parsed IS NOT NULL", "device_type_parsed_pct"),
        ("payment_parsed IS NOT NULL", "payment_mode_pct"),
        ("duration_parsed IS NOT NULL", "contract_duration_months_pct"),
        ("class_parsed IS NOT NULL", "policy_class_pct"),
        ("deviceType IS NULL", "device_missing_before_pct"),
        ("coalesce(deviceType, device_type_parsed) IS NULL", "device_missing_after_pct")]) + " FROM parsed"))
def a5_parse_coverage(spark, sf_dir):
    return round_doubles(Q.parse_coverage(raw_claims(spark, sf_dir, with_text=False)))


@query("a6_parse_agreement", with_ctes(CLAIMS_NT, _PARSED_RAW)(
    f"SELECT {r6(f'avg(CAST({_AGREE} AS DOUBLE))')} AS agreement_rate, count(*) AS n_both "
    "FROM parsed WHERE deviceType IS NOT NULL"))
def a6_parse_agreement(spark, sf_dir):
    return round_doubles(Q.parse_agreement(raw_claims(spark, sf_dir, with_text=False)))


@query("a7_segment_histogram", with_ctes(CLAIMS_NT)(
    "SELECT CAST(len(string_split(productName, '_')) AS BIGINT) AS segments, count(*) AS n "
    "FROM claims WHERE productName IS NOT NULL GROUP BY 1"))
def a7_segment_histogram(spark, sf_dir):
    return Q.segment_histogram(raw_claims(spark, sf_dir, with_text=False))


_DIAG_NOTNA = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in C.DIAGNOSTIC_COLUMNS)


@query("a8_decline_rate_by_dimension", with_ctes(CLAIMS_NT, _PARSED_RAW)(
    "SELECT dimension, level, " + r6("avg(y)") + " AS decline_rate, count(*) AS n FROM ("
    "SELECT 'device' AS dimension, device_type_parsed AS level, CASE WHEN status = 'Declined' THEN 1 ELSE 0 END AS y FROM parsed "
    f"UNION ALL SELECT 'diag_completeness', CAST({_DIAG_NOTNA} AS VARCHAR), CASE WHEN status = 'Declined' THEN 1 ELSE 0 END FROM parsed "
    "UNION ALL SELECT 'channel', channel, CASE WHEN status = 'Declined' THEN 1 ELSE 0 END FROM parsed"
    ") WHERE level IS NOT NULL GROUP BY dimension, level"))
def a8_decline_rate_by_dimension(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False).withColumn("__p", parse_product_name("productName"))
    y = (F.col("status") == C.POSITIVE_CLASS).cast("int")
    notna = sum((F.col(c).isNotNull().cast("int") for c in C.DIAGNOSTIC_COLUMNS), F.lit(0))
    out = Q.decline_rate_by(raw, {"device": F.col("__p.device_type_parsed"),
                                  "diag_completeness": notna, "channel": F.col("channel")}, y)
    return round_doubles(out.where(F.col("level").isNotNull()))


def _quart_sql(measure, group, src):
    q = f"quantile_cont(CAST({measure} AS DOUBLE), [0.25, 0.5, 0.75])"
    return (f"SELECT '{measure}' AS measure, '{group}' AS group_by, CAST({group} AS VARCHAR) AS grp, "
            f"{r6(q + '[1]')} AS q1, {r6(q + '[2]')} AS median, {r6(q + '[3]')} AS q3 FROM {src} GROUP BY {group}")


@query("a9_quartiles_by_group", with_ctes(*FEATURE_CTES)(" UNION ALL ".join([
    _quart_sql("diag_completeness", "channel", "derived"),
    _quart_sql("rrp", "country", "derived"),
    _quart_sql("issue_desc_length", "country", "derived")])))
def a9_quartiles_by_group(spark, sf_dir):
    from claimscope.operators.features import derive
    raw = claims_for_features(spark, sf_dir)
    d = derive(fitted_cleaner(raw).transform(raw)).cache()
    out = (Q.quartiles_by(d, "diag_completeness", "channel")
           .unionByName(Q.quartiles_by(d, "rrp", "country"))
           .unionByName(Q.quartiles_by(d, "issue_desc_length", "country")))
    return round_doubles(out)


_RATIO_SRC = ("(SELECT country, status, excessFee / rrp AS fee_to_rrp_ratio, balanceRRP / rrp AS balance_ratio "
              "FROM cur WHERE rrp > 0)")


@query("a10_ratio_medians_by_country", with_ctes(CLAIMS_NT, CURRENCY)(
    f"SELECT country, {r6('quantile_cont(fee_to_rrp_ratio, 0.5)')} AS fee_to_rrp_ratio, "
    f"{r6('quantile_cont(balance_ratio, 0.5)')} AS balance_ratio FROM {_RATIO_SRC} GROUP BY country"))
def a10_ratio_medians_by_country(spark, sf_dir):
    cur = CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False)).where(F.col("rrp") > 0)
    r = cur.select("country", (F.col("excessFee") / F.col("rrp")).alias("fee_to_rrp_ratio"),
                   (F.col("balanceRRP") / F.col("rrp")).alias("balance_ratio"))
    return round_doubles(r.groupBy("country").agg(F.percentile("fee_to_rrp_ratio", 0.5).alias("fee_to_rrp_ratio"),
                                                  F.percentile("balance_ratio", 0.5).alias("balance_ratio")))


@query("a10_ratio_q99_by_outcome", with_ctes(CLAIMS_NT, CURRENCY)(
    f"SELECT status, {r6('quantile_cont(fee_to_rrp_ratio, 0.99)')} AS fee_to_rrp_ratio_q99, "
    f"{r6('quantile_cont(balance_ratio, 0.99)')} AS balance_ratio_q99 FROM {_RATIO_SRC} GROUP BY status"))
def a10_ratio_q99_by_outcome(spark, sf_dir):
    cur = CL.normalise_currency(raw_claims(spark, sf_dir, with_text=False)).where(F.col("rrp") > 0)
    r = cur.select("status", (F.col("excessFee") / F.col("rrp")).alias("f"),
                   (F.col("balanceRRP") / F.col("rrp")).alias("b"))
    return round_doubles(r.groupBy("status").agg(F.percentile("f", 0.99).alias("fee_to_rrp_ratio_q99"),
                                                 F.percentile("b", 0.99).alias("balance_ratio_q99")))


@query("a11_target_correlation", with_ctes(*FEATURE_CTES)(
    f"SELECT feature, {r6('r')} AS corr FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, corr(CAST({n} AS DOUBLE), CAST(status AS DOUBLE)) AS r FROM matrix"
        for n in FEATURE_NAMES) + ") WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC, feature LIMIT 10"))
def a11_target_correlation(spark, sf_dir):
    m, enc = feature_matrix(spark, sf_dir)
    return round_doubles(Q.correlation_with_target(m, enc.feature_names))


@query("a12_narrative_length_histogram", with_ctes(*FEATURE_CTES)(
    "SELECT CAST(least(49, floor((x - lo) * 50 / (hi - lo))) AS BIGINT) AS bin, count(*) AS n FROM "
    "(SELECT x, min(x) OVER () AS lo, max(x) OVER () AS hi FROM "
    "(SELECT least(CAST(issue_desc_length AS DOUBLE), CAST(1200 AS DOUBLE)) AS x FROM derived)) GROUP BY 1"))
def a12_narrative_length_histogram(spark, sf_dir):
    from claimscope.operators.features import derive
    raw = claims_for_features(spark, sf_dir)
    return Q.length_histogram(derive(fitted_cleaner(raw).transform(raw)), "issue_desc_length")
