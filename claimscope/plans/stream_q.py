"""Contract, redaction, text-repair and throttle queries (P8, P13-P16, T5, T6 batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.functions.text import corrupt_as_cp1252, repair_mojibake
from claimscope.operators.redact import redact
from claimscope.plans.registry import query, with_ctes
from claimscope.sources.claims import claims_sql, raw_claims
from claimscope.sources.tables import read_table
from claimscope.streaming import jobs as J

REPLAY_LIMITS = C.THROTTLE_LIMITS
_DAY_US = 86_400_000_000
REQUEST_EXPRS = [
    ("client", "CASE WHEN event_id % 2 = 0 THEN 'c_hot' ELSE 'c' || CAST(user_id AS STRING) END"),
    ("path", "CASE WHEN event_type IN ('view', 'click') THEN '/api/v1/predict' "
             "WHEN event_type IN ('signup', 'purchase') THEN '/api/v1/explain' ELSE '/api/v1/health' END"),
    ("request_id", "event_id"),
    # every day of events as 40 seconds of requests, then a pause of 80
    ("ts", f"CAST((us - us % {_DAY_US}) / {_DAY_US} - first_day AS DOUBLE) * 120 + CAST(us % {_DAY_US} AS DOUBLE) / {_DAY_US} * 40"),
]


def requests(spark, sf_dir):
    """Events as API requests, in seconds; one client sends half of them."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    ev = ev.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    first = ev.select(F.min(F.expr(f"us div {_DAY_US}"))).scalar()
    ev = ev.withColumn("first_day", first)
    return ev.selectExpr(*[f"{e.replace(f'(us - us % {_DAY_US}) / {_DAY_US}', f'us div {_DAY_US}')} AS {n}" for n, e in REQUEST_EXPRS])


_LIMIT = "CASE path " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in REPLAY_LIMITS.items()) + " END"
_SPAN = C.THROTTLE_WINDOW_S
# request by request: the accepted times of the last 60 seconds are carried along
_THROTTLE_SQL = f"""WITH RECURSIVE ev AS (SELECT *, epoch_us(ts) AS us FROM events),
fd AS (SELECT min(us // {_DAY_US}) AS first_day FROM ev),
req AS (SELECT {", ".join(f"{e.replace(f'(us - us % {_DAY_US}) / {_DAY_US}', f'us // {_DAY_US}')} AS {n}" for n, e in REQUEST_EXPRS)} FROM ev, fd),
num AS (SELECT *, {_LIMIT} AS lim, row_number() OVER (PARTITION BY client, path ORDER BY ts, request_id) AS rn FROM req),
st AS (
  SELECT client, path, ts, request_id, rn, lim, [ts] AS win, true AS allowed, 0 AS retry_after, lim - 1 AS remaining FROM num WHERE rn = 1 AND lim IS NOT NULL
  UNION ALL
  SELECT client, path, ts, request_id, rn, lim, CASE WHEN len(w) >= lim THEN w ELSE list_append(w, ts) END, len(w) < lim,
    CASE WHEN len(w) >= lim THEN greatest(CAST(trunc(61.0 - (ts - w[1])) AS INTEGER), 1) ELSE 0 END,
    CASE WHEN len(w) >= lim THEN 0 ELSE lim - len(w) - 1 END
  FROM (SELECT n.*, list_filter(s.win, lambda x: n.ts - x <= {_SPAN}) AS w FROM st s JOIN num n ON n.client = s.client AND n.path = s.path AND n.rn = s.rn + 1)),
decided AS (SELECT client, path, ts, request_id, allowed, CAST(retry_after AS INTEGER) AS retry_after, CAST(remaining AS INTEGER) AS remaining FROM st
  UNION ALL SELECT client, path, ts, request_id, true, 0, CAST(NULL AS INTEGER) FROM num WHERE lim IS NULL)
"""


@query("t6_request_throttle", _THROTTLE_SQL + "SELECT * FROM decided")
def t6_request_throttle(spark, sf_dir):
    """T6 batch twin: exact sliding-window throttle decisions per (client, path), session by session."""
    return J.throttle_batch(requests(spark, sf_dir), REPLAY_LIMITS)


@query("t6_throttle_summary", _THROTTLE_SQL + "SELECT path, count(*) AS n, count_if(NOT allowed) AS rejected FROM decided GROUP BY path")
def t6_throttle_summary(spark, sf_dir):
    out = J.throttle_batch(requests(spark, sf_dir), REPLAY_LIMITS)
    return out.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("allowed")).alias("rejected"))


# Contract over raw claims read as requests; rejected field names only (no values echoed).
_P13_SQL = []
for _c in C.REQUIRED_FIELDS:
    _P13_SQL.append(f"CASE WHEN {_c} IS NULL OR trim(CAST({_c} AS VARCHAR)) = '' THEN '{_c}' END")
for _c, _vals in C.ENUMS.items():
    _P13_SQL.append(f"CASE WHEN {_c} IS NOT NULL AND {_c} NOT IN ({', '.join(repr(v) for v in _vals)}) THEN '{_c}' END")
_P13_SQL.append("CASE WHEN rrp <= 0 THEN 'rrp' END")
for _c in ("balanceRRP", "excessFee", "oldBalanceRRP"):
    _P13_SQL.append(f"CASE WHEN {_c} < 0 THEN '{_c}' END")
for _c in C.CONTRACT_DIAGNOSTICS:
    _P13_SQL.append(f"CASE WHEN {_c} < 0 OR {_c} > 1 THEN '{_c}' END")
_P13_LIST = "list_filter([" + ", ".join(_P13_SQL) + "], lambda x: x IS NOT NULL)"


@query("p13_p15_contract_quarantine", with_ctes(claims_sql())(
    f"SELECT claim_id, array_to_string({_P13_LIST}, ',') AS rejected_fields FROM claims "
    f"WHERE len({_P13_LIST}) > 0"))
def p13_p15_contract_quarantine(spark, sf_dir):
    """P13 rule names per rejected claim; P15 the quarantine record carries no submitted values."""
    raw = raw_claims(spark, sf_dir)
    _, rejected = J.split_valid(raw)
    return rejected.select("claim_id", F.array_join("rejected_fields", ",").alias("rejected_fields"))


KNOWN = C.REQUEST_FIELDS


@query("p14_unknown_fields", with_ctes(claims_sql(with_text=False))(
    "SELECT claim_id, ['customer_tier'] AS unknown_fields FROM claims WHERE claim_key % 50 = 0"))
def p14_unknown_fields(spark, sf_dir):
    """Requests (JSON) carrying keys outside the contract are rejected with those keys."""
    raw = raw_claims(spark, sf_dir)
    cols = [c for c in KNOWN if c in raw.columns]
    extra = F.when(F.col("claim_key") % 50 == 0, F.lit("gold"))
    js = raw.select("claim_id", F.to_json(F.struct(*cols, extra.alias("customer_tier"))).alias("body"))
    unknown = F.array_except(F.json_object_keys("body"), F.array(*[F.lit(k) for k in KNOWN]))
    return js.select("claim_id", unknown.alias("unknown_fields")).where(F.size("unknown_fields") > 0)


@query("p16_redaction", with_ctes(claims_sql())(
    f"SELECT claim_id, '{C.REDACTED}' AS issueDesc, '{C.REDACTED}' AS other, "
    f"'{C.REDACTED}' AS contact_email, country AS contact_country FROM claims"))
def p16_redaction(spark, sf_dir):
    """PII keys are redacted at any depth (here a nested contact struct), values kept otherwise."""
    raw = raw_claims(spark, sf_dir)
    rec = raw.select("claim_id", "issueDesc", "other",
                     F.struct(F.concat(F.lit("u"), F.col("claim_key").cast("string"), F.lit("@x.test")).alias("email"),
                              F.col("country").alias("country")).alias("contact"))
    red = redact(rec)
    return red.select("claim_id", "issueDesc", "other", F.col("contact.email").alias("contact_email"),
                      F.col("contact.country").alias("contact_country"))


_UNDEFINED_BYTES = "regexp_matches(hex(encode(text)), '^(?:..)*(?:81|8D|8F|90|9D)')"


@query("p8_repair_mojibake_roundtrip", f"SELECT doc_id, NOT {_UNDEFINED_BYTES} AS cp1252_defined, "
       f"NOT {_UNDEFINED_BYTES} AS restored FROM documents")
def p8_repair_mojibake_roundtrip(spark, sf_dir):
    """P8 (Q*): read each whole document's UTF-8 as windows-1252, repair, compare with the original.

    Where a byte of the text is unassigned in windows-1252 the corruption cannot happen
    (and repair leaves the text unchanged); elsewhere repair must restore it exactly.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    once = corrupt_as_cp1252("text")
    defined = ~once.rlike(r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]")
    return docs.select("doc_id", defined.alias("cp1252_defined"),
                       (repair_mojibake(once) == F.col("text")).alias("restored"))


def _score_and_flag_inputs(df):
    """Pseudo-score stand-in for the model, plus the inputs the flags read (EUR rrp, diagnostics run)."""
    from claimscope.plans.explain_q import DECISION_EXPRS
    exprs = dict(DECISION_EXPRS)
    return df.selectExpr("claim_id", "claimType", "policyStatus", f"{exprs['rrp_eur']} AS rrp",
                         f"{exprs['diag_completeness']} AS diag_completeness", f"{exprs['score']} AS score")


def _t4_sql():
    from claimscope.plans.explain_q import DEC_CTES
    return with_ctes(*DEC_CTES)(
        "SELECT claim_id, requires_human_review, human_review_reason, decision FROM dec "
        "WHERE claim_id IN (SELECT claim_id FROM claims WHERE NOT (rrp <= 0 OR balanceRRP < 0 OR productName IS NULL))")


@query("t4_stream_routing", _t4_sql())
def t4_stream_routing(spark, sf_dir):
    """T4: claims arrive as files; a stream validates (P13), scores and routes (D1/D2) them."""
    import uuid
    from claimscope.session import ensure_checkpoint_dir
    root = f"{ensure_checkpoint_dir(spark)}/t4-{uuid.uuid4().hex}"
    raw = raw_claims(spark, sf_dir)
    raw.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    routed = J.route_stream(stream, _score_and_flag_inputs)
    q = (routed.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("claim_id", "requires_human_review", "human_review_reason",
                                                    "decision")
