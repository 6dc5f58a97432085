"""Decision and explanation-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.operators import decide as DE
from claimscope.operators import explain as EX
from claimscope.plans.registry import query, with_ctes
from claimscope.session import compiled_in_parts
from claimscope.sources.claims import claims_sql, raw_claims

PERSONAS = tuple(C.PERSONAS)
THRESHOLD = 0.5
_DIAG_CNT = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in C.DIAGNOSTIC_COLUMNS)

# (column, SQL) valid in both engines, over the raw claim columns + status.
DECISION_EXPRS = [
    ("claim_id", "claim_id"),
    ("k", "claim_key"),
    ("claimType", "claimType"),
    ("policyStatus", "policyStatus"),
    ("rrp_eur", "CASE WHEN rrp <= 0 THEN NULL WHEN country = 'SE' THEN rrp / CAST(10.3 AS DOUBLE) ELSE rrp END"),
    ("fee_eur", "CASE WHEN country = 'SE' THEN excessFee / CAST(10.3 AS DOUBLE) ELSE excessFee END"),
    ("diag_completeness", f"CAST({_DIAG_CNT} AS BIGINT)"),
    ("balance_eur", "CASE WHEN country = 'SE' THEN balanceRRP / CAST(10.3 AS DOUBLE) ELSE balanceRRP END"),
    ("deviceType", "deviceType"), ("coverage", "coverage"), ("country", "country"), ("channel", "channel"), ("productCode", "productCode"),
    # a stand-in for a model's output that both engines can compute; it reads no label
    ("score", "CAST((claim_key * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(0.8 AS DOUBLE) "
              "+ CASE WHEN coverage = 'ADLD/THEFT' AND claim_key % 2 = 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"),
]
_FLAGS_SQL = ("list_filter([CASE WHEN claimType = 'Theft' THEN 'theft_claim' END, "
              "CASE WHEN policyStatus = 'Grace Period' THEN 'grace_period_policy' END, "
              f"CASE WHEN coalesce(rrp_eur, 0) > {C.HIGH_VALUE_RRP_EUR} THEN 'high_value_claim' END, "
              f"CASE WHEN diag_completeness < {C.MIN_DIAG_COMPLETENESS} THEN 'insufficient_diagnostics' END], "
              "lambda x: x IS NOT NULL)")
ROUTE_SQL = (f"CASE WHEN score >= {C.MANDATORY_REVIEW_ABOVE} THEN 'high_decline_risk' "
             f"WHEN score >= {C.STRAIGHT_THROUGH_BELOW} THEN 'borderline_confidence' "
             "WHEN len(flags) > 0 THEN 'forced_review:' || flags[1] END")
DECISION_SQL = (f"CASE WHEN score >= {C.MANDATORY_REVIEW_ABOVE} THEN '{C.DECISION_EXPERT_REVIEW}' "
                f"WHEN score >= {C.STRAIGHT_THROUGH_BELOW} OR len(flags) > 0 THEN '{C.DECISION_UNDER_REVIEW}' "
                f"ELSE '{C.DECISION_STRAIGHT_THROUGH}' END")
CLAIMS_NT = claims_sql(with_text=False)
DEC_CTES = (CLAIMS_NT,
            "dbase AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DECISION_EXPRS) + " FROM claims)",
            f"dflags AS (SELECT *, {_FLAGS_SQL} AS flags FROM dbase)",
            f"dec AS (SELECT *, {ROUTE_SQL} AS human_review_reason, {DECISION_SQL} AS decision, "
            f"score >= {C.STRAIGHT_THROUGH_BELOW} OR len(flags) > 0 AS requires_human_review, "
            f"score >= {C.MANDATORY_REVIEW_ABOVE} AS is_declined FROM dflags)")


def decisions(spark, sf_dir):
    raw = raw_claims(spark, sf_dir, with_text=False)
    base = raw.selectExpr(*[f"{e} AS {n}" for n, e in DECISION_EXPRS])
    d = base.withColumn("flags", DE.risk_flags(rrp="rrp_eur")).withColumn("__g", DE.route(F.col("score"), F.col("flags")))
    return d.select("*", "__g.*").drop("__g").withColumn("is_declined", F.col("score") >= C.MANDATORY_REVIEW_ABOVE)


@query("d1_risk_flags", with_ctes(*DEC_CTES)("SELECT claim_id, array_to_string(flags, ',') AS risk_flags FROM dflags"))
def d1_risk_flags(spark, sf_dir):
    return decisions(spark, sf_dir).select("claim_id", F.array_join("flags", ",").alias("risk_flags"))


_OUTCOME = (f"CASE WHEN requires_human_review THEN '{C.OUTCOME_REVIEW}' ELSE '{C.OUTCOME_NO_REVIEW}' END")


@query("d2_route_and_outcome", with_ctes(*DEC_CTES)(
    f"SELECT claim_id, requires_human_review, human_review_reason, decision, {_OUTCOME} AS outcome_statement FROM dec"))
def d2_route_and_outcome(spark, sf_dir):
    """D2 gate (never a decline) and D5 outcome statement."""
    d = decisions(spark, sf_dir)
    return d.select("claim_id", "requires_human_review", "human_review_reason", "decision",
                    DE.outcome_statement(F.col("requires_human_review")).alias("outcome_statement"))


def contexts(d):
    """Decisions with the columns that persona contexts draw on (amounts in EUR), derived once."""
    return d.withColumns({"rrp": F.col("rrp_eur"), "excessFee": F.col("fee_eur"), "balanceRRP": F.col("balance_eur"), "policy_class": F.lit(None).cast("string"),
                          "decline_risk_score": F.round("score", 4), "decision_threshold": F.lit(THRESHOLD), "risk_flags": F.col("flags"),
                          "model_version": F.lit("1"), "model_algorithm": F.lit("stand_in")})


# ---------------------------------------------------------------- responses (shared SQL)

def _json(persona: str, summary: str, factors: str = "[\"The cover on the policy\", \"The type of damage reported\"]") -> str:
    head = f"'{{\"summary\": \"' || {summary} || '\", \"key_factors\": {factors}'"
    tail = {
        "customer": "', \"next_steps\": [\"Keep your receipt.\"]}'",
        "adjuster": "', \"risk_assessment\": \"Moderate.\", \"review_notes\": \"Check the diagnostics.\"}'",
        "auditor": "', \"provenance_record\": \"Model version 1.\", \"human_oversight\": \"Recorded.\", "
                   "\"limitations\": \"Synthetic.\"}'",
    }[persona]
    return f"{head} || {tail}"


_BS = "' || chr(92) || '"   # a backslash, which the two engines read differently inside a literal
_S_OK = ("'Claim ' || claim_id || ' concerns a device valued at ' || "
         "coalesce(CAST(CAST(floor(rrp_eur) AS BIGINT) AS STRING), 'an unknown amount') || ' EUR.'")
_VARIANTS = [
    lambda p: "'```json' || chr(10) || " + _json(p, _S_OK) + " || chr(10) || '```'",
    lambda p: "'Sorry, I cannot help with that.'",
    lambda p: "'[\"not\", \"an\", \"object\"]'",
    lambda p: "replace(" + _json(p, _S_OK) + ", '\"key_factors\"', '\"factors\"')",
    lambda p: _json(p, _S_OK + " || ' Your claim was declined.'"),
    lambda p: _json(p, _S_OK + " || ' It was auto-approved.'"),
    lambda p: _json(p, _S_OK + " || ' The probability threshold decided it.'"),
    lambda p: _json(p, _S_OK + " || ' A fee of 98765 EUR applies.'"),
    lambda p: _json(p, _S_OK + " || ' A colleague will check it.'"),
    lambda p: _json(p, "''"),
    lambda p: _json(p, _S_OK + " || ' The decision is final.'"),
    lambda p: _json(p, _S_OK),
    # escapes and nested leaves: a line break inside an assertion, an escaped letter, an escaped quote before a colon
    lambda p: _json(p, _S_OK, f'[{{"name": "cover", "detail": {{"text": "It was{_BS}ndeclined before."}}}}]'),
    lambda p: _json(p, _S_OK + f" || ' It was {_BS}u0064eclined.'"),
    lambda p: _json(p, _S_OK, f'["a {_BS}"declined{_BS}": b", {{"declined": "no"}}]'),
    # numbers as leaves, nested; a figure from the context with all its decimals; leaves that meet
    lambda p: _json(p, _S_OK, '[{"amount": 98765, "parts": [12.5, 4321.25, -7]}, true, null]'),
    lambda p: _json(p, "'Fee ' || coalesce(CAST(fee_eur AS STRING), 'none') || '.'", '["The claim was", "declined", 3]'),
    # fields that are there but hold nothing
    lambda p: _json(p, _S_OK, "[]"), lambda p: _json(p, _S_OK, "0"), lambda p: _json(p, _S_OK, "false"), lambda p: _json(p, _S_OK, "null"),
    lambda p: _json(p, _S_OK, '"0"'), lambda p: _json(p, _S_OK, "{}"),
]


_VARIANT = f"(k + attempt) % {len(_VARIANTS)}"


def response_sql(variant: str = _VARIANT) -> str:
    cases = []
    for p in PERSONAS:
        inner = " ".join(f"WHEN {i} THEN {v(p)}" for i, v in enumerate(_VARIANTS))
        cases.append(f"WHEN '{p}' THEN CASE {variant} {inner} END")
    return "CASE persona " + " ".join(cases) + " END"


#: Facts of each attempt, valid in both engines.
ATTEMPT_EXPRS = [
    ("provider_failed", "k % 23 = 0 AND attempt = 1 OR k % 19 = 0 AND attempt = 2"),
    ("provider", "CASE (k + attempt) % 3 WHEN 0 THEN 'groq' WHEN 1 THEN 'openai' ELSE 'gemini' END"),
    ("model", "CASE (k + attempt) % 3 WHEN 0 THEN 'llama-3.3-70b' WHEN 1 THEN 'gpt-4o-mini' ELSE 'gemini-2.0-flash' END"),
    ("latency_ms", "CAST((k * 37 + attempt * 11) % 9000 AS BIGINT)"),
    ("prompt_tokens", "CAST(100 + k % 900 AS BIGINT)"),
    ("completion_tokens", "CAST(20 + (k + attempt) % 200 AS BIGINT)"),
    ("cost_usd", "CAST(120 + k % 900 + (k + attempt) % 200 AS DOUBLE) * CAST(0.000001 AS DOUBLE)"),
    ("used_fallback_provider", "(k + attempt) % 3 <> 0"),
]


def responses(spark, sf_dir):
    """One generated response per claim, persona and attempt (two attempts), with the context its writer was shown."""
    compiled_in_parts(spark)
    d = DE.with_claim_fields(contexts(decisions(spark, sf_dir)))
    d = d.withColumn("persona", F.explode(F.array(*[F.lit(p) for p in PERSONAS])))
    return answers(d.withColumn("context", DE.context_json(F.col("persona"), derived=True)))


def answers(d, more_grounds=None):
    """Two answers to each context (claim, persona), with the facts of their calls and the figures the context grounds.

    ``more_grounds``: an array of figures beside those in ``context``, of texts that the context shows but the column does not hold.
    """
    d = EX.with_shown_numbers(d, "grounds")
    if more_grounds is not None:
        d = d.withColumn("grounds", F.concat(F.coalesce("grounds", F.array().cast("array<double>")), more_grounds))
    r = d.select("claim_id", "k", "persona", "requires_human_review", "is_declined", "context", "grounds", "rrp_eur", "fee_eur",
                 F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    r = r.withColumn("__variant", F.expr(_VARIANT))             # once, not in every branch
    r = r.withColumn("response", F.expr(response_sql("__variant").replace("chr(", "char(")))
    return r.withColumns({n: F.expr(e) for n, e in ATTEMPT_EXPRS}).drop("rrp_eur", "fee_eur", "__variant")


def validated(spark, sf_dir):
    return EX.summary(EX.validate(responses(spark, sf_dir), allowed_col="grounds"))


# ---------------------------------------------------------------- DuckDB twin of the validator

_FENCE_SQL = r"trim(regexp_replace(response, '(?m)^\s*```(?:json)?\s*|\s*```\s*$', '', 'g'))"
def _schema_errs_sql():
    """Missing or empty by the parsed JSON type of the field."""
    parts = []
    for p, fields in C.RESPONSE_REQUIRED_FIELDS.items():
        for f in fields:
            kind, raw, at = f"json_type(body, '$.{f}')", f"json_extract_string(body, '$.{f}')", f"json_extract(body, '$.{f}')"
            empty = (f"CASE {kind} WHEN 'NULL' THEN true WHEN 'VARCHAR' THEN {raw} = '' WHEN 'BOOLEAN' THEN {raw} = 'false' "
                     f"WHEN 'ARRAY' THEN json_array_length({at}) = 0 WHEN 'OBJECT' THEN len(json_keys({at})) = 0 "
                     f"ELSE TRY_CAST({raw} AS DOUBLE) = 0 END")
            parts.append(f"CASE WHEN persona = '{p}' AND ({kind} IS NULL OR {empty}) THEN 'schema' END")
    return parts


def _err_list_sql():
    parts = _schema_errs_sql()
    parts += [f"CASE WHEN contains(txt, '{t}') THEN 'forbidden_wording' END" for t in C.FORBIDDEN_EVERYWHERE]
    parts += [f"CASE WHEN persona = 'customer' AND contains(txt, '{t}') THEN 'customer_leakage' END"
              for t in C.CUSTOMER_BLOCKLIST]
    rx = lambda pat: "regexp_matches(txt, '(?i)" + pat.replace("'", "''") + "')"
    parts += [f"CASE WHEN NOT is_declined AND {rx(C.DECLINED_ASSERTIONS)} THEN 'sentiment_consistency' END",
              f"CASE WHEN requires_human_review AND {rx(C.FINALITY_ASSERTIONS)} THEN 'sentiment_consistency' END",
              f"CASE WHEN requires_human_review AND {rx(C.REVIEWED_ASSERTIONS)} THEN 'sentiment_consistency' END",
              f"CASE WHEN NOT requires_human_review AND {rx(C.PROMISED_REVIEW)} THEN 'sentiment_consistency' END"]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _hu(x, d):
    s = float(10 ** d)
    return f"floor(({x}) * {s} + 0.5) / {s}"


# every number a persona's context holds: none for customers, amounts, score, threshold and the digits of the product code
# for the others, and the version for auditors
_CODE_NUMS = f"list_transform(regexp_extract_all(coalesce(productCode, ''), '{C.NUMBER_TOKEN}', 2), lambda t: CAST(replace(t, ',', '.') AS DOUBLE))"
_SHOWN = (f"CASE WHEN persona = 'customer' THEN CAST([] AS DOUBLE[]) ELSE list_concat(list_concat([rrp_eur, fee_eur, balance_eur, round(score, 4), "
          f"CAST({THRESHOLD} AS DOUBLE)], {_CODE_NUMS}), CASE WHEN persona = 'auditor' THEN [CAST(1 AS DOUBLE)] ELSE CAST([] AS DOUBLE[]) END) END")
_ALLOWED = (f"flatten(list_transform(list_filter({_SHOWN}, lambda v: v IS NOT NULL), "
            "lambda v: [v, " + _hu("v", 2) + ", " + _hu("v", 1) + ", " + _hu("v", 0) + "]))")
_NUMS = ("list_transform(regexp_extract_all(txt, '" + C.NUMBER_TOKEN + "', 2), "
         "lambda t: CAST(replace(t, ',', '.') AS DOUBLE))")
_UNGROUNDED = (f"len(list_filter({_NUMS}, lambda v: abs(v) >= {C.GROUNDING_MIN_MAGNITUDE} AND "
               f"len(list_filter({_ALLOWED}, lambda a: abs(v - a) <= {C.GROUNDING_TOLERANCE} * greatest(abs(a), 1))) = 0))")

RESP_CTES = DEC_CTES + (
    f"resp0 AS (SELECT *, {response_sql()} AS response FROM dec "
    f"CROSS JOIN (VALUES {', '.join(f'({chr(39)}{p}{chr(39)})' for p in PERSONAS)}) pp(persona) "
    "CROSS JOIN (VALUES (1), (2)) aa(attempt))",
    "resp AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in ATTEMPT_EXPRS) + " FROM resp0)",
    f"rb AS (SELECT *, {_FENCE_SQL} AS body FROM resp)",
    "rj0 AS (SELECT *, json_valid(body) AS is_json FROM rb)",
    "rj AS (SELECT * REPLACE (CASE WHEN is_obj THEN body ELSE '{}' END AS body), body AS raw_body, is_obj FROM "
    "(SELECT *, coalesce(json_type(CASE WHEN is_json THEN body ELSE '0' END) = 'OBJECT', false) AS is_obj FROM rj0))",
    # the leaves as DuckDB's own JSON parser walks them
    "leaves AS (SELECT r.claim_id, r.persona, r.attempt, t.id, CASE t.type WHEN 'VARCHAR' THEN json_extract_string(t.atom, '$') "
    "WHEN 'NULL' THEN 'none' ELSE CAST(t.atom AS VARCHAR) END AS x FROM rj r, json_tree(r.body) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))",
    "texts AS (SELECT claim_id, persona, attempt, lower(string_agg(x, ' ' ORDER BY id)) AS txt FROM leaves GROUP BY ALL)",
    "rt AS (SELECT rj.*, CASE WHEN is_obj THEN coalesce(texts.txt, '') END AS txt FROM rj LEFT JOIN texts USING (claim_id, persona, attempt))",
    f"""val AS (SELECT *, CASE WHEN is_obj THEN {_err_list_sql()} ELSE ['json_parse'] END AS errs,
         CASE WHEN is_obj THEN {_UNGROUNDED} ELSE 0 END AS n_warn FROM rt)""",
    "vsum AS (SELECT *, len(errs) = 0 AS passed, "
    "CAST(len(errs) AS BIGINT) AS n_errors, CAST(n_warn AS BIGINT) AS n_warnings, "
    "array_to_string(errs, ',') AS failed_checks FROM val)",
    # attempt by attempt: the loop goes on while no provider has failed and nothing has passed
    "loop AS (SELECT *, sum(CAST(provider_failed AS INTEGER)) OVER (PARTITION BY claim_id, persona ORDER BY attempt) AS n_failed FROM vsum)",
    "won AS (SELECT claim_id, persona, any_value(requires_human_review) AS requires_human_review, any_value(k) AS k, "
    f"min(attempt) FILTER (passed AND n_failed = 0 AND attempt <= {C.MAX_RETRIES_ON_FAILURE + 1}) AS attempt_used FROM loop GROUP BY claim_id, persona)",
)


@query("d18_validation_summary", with_ctes(*RESP_CTES)(
    "SELECT claim_id, persona, attempt, passed, n_errors, n_warnings, failed_checks FROM vsum"))
def d18_validation_summary(spark, sf_dir):
    """D10-D13 + D18: parse, schema, wording, leakage, consistency, grounding -> summary per response."""
    return validated(spark, sf_dir).select("claim_id", "persona", "attempt", "passed", "n_errors",
                                           "n_warnings", "failed_checks")


@query("d14_attempt_resolution", with_ctes(*RESP_CTES)(
    f"SELECT claim_id, persona, attempt_used IS NULL AS used_template_fallback, coalesce(attempt_used > 1, {C.MAX_RETRIES_ON_FAILURE} > 0) AS retried, "
    "attempt_used FROM won"))
def d14_attempt_resolution(spark, sf_dir):
    """First passing attempt before any provider failure, else the template."""
    return EX.resolve_attempts(validated(spark, sf_dir), ["claim_id", "persona"])


def _fallback_sql():
    status = (f"CASE WHEN requires_human_review THEN '{C.TEMPLATE_UNDER_REVIEW}' ELSE '{C.TEMPLATE_PROCESSED}' END")
    summ = f"'Claim ' || claim_id || ' ' || {status} || '.'"
    base = f"'summary', {summ}, 'key_factors', ['{C.TEMPLATE_KEY_FACTOR}'], 'generated', 'template'"
    cust = f"json_object({base}, 'next_steps', ['{C.TEMPLATE_NEXT_STEP}'])"
    adj = f"json_object({base}, 'risk_assessment', '{C.TEMPLATE_RISK}', 'review_notes', '{C.TEMPLATE_REVIEW_NOTES}')"
    over = "'Human review ' || CASE WHEN requires_human_review THEN 'required' ELSE 'not required' END || '.'"
    aud = (f"json_object({base}, 'provenance_record', '{C.TEMPLATE_PROVENANCE}', 'human_oversight', {over}, "
           f"'limitations', '{C.TEMPLATE_LIMITATIONS}')")
    return f"CAST(CASE persona WHEN 'customer' THEN {cust} WHEN 'adjuster' THEN {adj} ELSE {aud} END AS VARCHAR)"


@query("d15_fallback_explanations", with_ctes(*RESP_CTES)(
    f"SELECT claim_id, persona, {_fallback_sql()} AS content FROM won WHERE attempt_used IS NULL"))
def d15_fallback_explanations(spark, sf_dir):
    """The template content for every response pair that ends on the template."""
    res = EX.resolve_attempts(validated(spark, sf_dir), ["claim_id", "persona"], carry=("requires_human_review",))
    return res.where("used_template_fallback").select("claim_id", "persona", DE.fallback_explanation(
        F.col("persona"), F.col("requires_human_review"), F.col("claim_id")).alias("content"))


@query("d20_batch_text_checks", with_ctes(*RESP_CTES)(
    "SELECT persona, count(*) AS n, count_if(list_contains(errs, 'customer_leakage')) AS vocabulary_hits, "
    "count_if(list_contains(errs, 'sentiment_consistency')) AS outcome_contradictions, "
    "floor(avg(CAST(passed AS DOUBLE)) * 1e6 + 0.5) / 1e6 AS pass_rate FROM vsum GROUP BY persona"))
def d20_batch_text_checks(spark, sf_dir):
    from claimscope.operators.evaluate import rnd
    out = EX.batch_text_checks(validated(spark, sf_dir))
    return out.withColumn("pass_rate", rnd("pass_rate", 6))
