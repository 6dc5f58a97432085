"""DuckDB oracle CTEs for cleaning and features, written independently of the Spark code."""

from __future__ import annotations

from claimscope import config as C
from claimscope.functions.text import PY_WHITESPACE
from claimscope.sources.claims import claims_sql


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def _date(col: str) -> str:
    s = f"trim({col})"
    return (f"coalesce(try_strptime({s}, '%Y-%m-%d %H:%M:%S'), try_strptime({s}, '%Y-%m-%d'), "
            f"try_strptime({s}, '%d/%m/%Y'), try_strptime({s}, '%d-%m-%Y'))")


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SEK = f"coalesce(country IN {_in(C.SEK_COUNTRIES)}, false)"

CURRENCY = f"""cur AS (
  SELECT * REPLACE (
      CASE WHEN {SEK} THEN rrp / CAST({C.SEK_TO_EUR} AS DOUBLE) ELSE rrp END AS rrp,
      CASE WHEN {SEK} THEN excessFee / CAST({C.SEK_TO_EUR} AS DOUBLE) ELSE excessFee END AS excessFee,
      CASE WHEN {SEK} THEN balanceRRP / CAST({C.SEK_TO_EUR} AS DOUBLE) ELSE balanceRRP END AS balanceRRP,
      CASE WHEN {SEK} THEN oldBalanceRRP / CAST({C.SEK_TO_EUR} AS DOUBLE) ELSE oldBalanceRRP END AS oldBalanceRRP),
    CASE WHEN {SEK} THEN 'SEK' ELSE 'EUR' END AS currency_original
  FROM claims
)"""

MEDIANS = """fee_medians AS (
  SELECT productCode, quantile_cont(excessFee, 0.5) AS excess_fee_median
  FROM cur WHERE productCode IS NOT NULL GROUP BY productCode
  HAVING quantile_cont(excessFee, 0.5) IS NOT NULL
),
fee_global AS (SELECT quantile_cont(excessFee, 0.5) AS gm FROM cur)"""

_diag_sql = ",\n    ".join(
    f"CAST(trunc(coalesce(TRY_CAST({c} AS DOUBLE), CAST(-1 AS DOUBLE))) AS INTEGER) AS {c}"
    for c in C.DIAGNOSTIC_COLUMNS)

CLEANED = f"""cleaned AS (
  SELECT cur.claim_id, cur.claim_key, cur.doc_key,
    CASE WHEN cur.excessFee IS NULL THEN coalesce(m.excess_fee_median, g.gm) ELSE cur.excessFee END AS excessFee,
    CASE WHEN cur.rrp <= 0 THEN NULL ELSE cur.rrp END AS rrp,
    CASE WHEN cur.balanceRRP < 0 THEN NULL ELSE cur.balanceRRP END AS balanceRRP,
    productName, coverage, coalesce(cur.productCode, 'UNKNOWN') AS productCode,
    {_date('policyStartDate')} AS policyStartDate,
    {_date('policyEndDate')} AS policyEndDate,
    {_date('purchaseDate')} AS purchaseDate,
    policyStatus, coalesce(retailerName, 'UNKNOWN') AS retailerName,
    coalesce(deviceType, 'UNKNOWN') AS deviceType, model, channel, claimType, country,
    CASE WHEN status = 'Declined' THEN 1 ELSE 0 END AS status,
    {_diag_sql},
    other, issueDesc, currency_original
  FROM cur
  LEFT JOIN fee_medians m ON m.productCode = coalesce(cur.productCode, 'UNKNOWN')
  CROSS JOIN fee_global g
)"""


def _map_case(expr: str, mapping: dict, cast: str = "") -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} END"


def _first_token(keys) -> str:
    return f"list_filter(toks, lambda t: t IN {_in(keys)})[1]"


PARSED = f"""parsed AS (
  SELECT *,
    {_map_case(_first_token(C.DEVICE_TOKENS), C.DEVICE_TOKENS)} AS device_type_parsed,
    {_map_case(_first_token(C.PAYMENT_TOKENS), C.PAYMENT_TOKENS)} AS payment_parsed,
    {_map_case(_first_token(C.DURATION_TOKENS), C.DURATION_TOKENS)} AS duration_parsed,
    {_first_token(C.POLICY_CLASS_TOKENS)} AS class_parsed
  FROM (SELECT *, CASE WHEN productName IS NULL OR trim(productName) = '' THEN NULL
               ELSE list_transform(string_split(productName, '_'), lambda t: upper(trim(t))) END AS toks
        FROM cleaned)
)"""


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / CAST(86400000000 AS DOUBLE)) AS BIGINT)"


def _count_diag(pred: str) -> str:
    return "CAST(" + " + ".join(f"CAST(coalesce({pred.format(c=c)}, false) AS INTEGER)"
                                for c in C.DIAGNOSTIC_COLUMNS) + " AS BIGINT)"


def _finite(x: str) -> str:
    return f"CASE WHEN isinf({x}) THEN NULL ELSE {x} END"


DERIVED = f"""derived AS (
  SELECT claim_id, claim_key, doc_key, excessFee, rrp, balanceRRP, coverage, productCode,
    policyStatus, retailerName,
    coalesce(CASE WHEN deviceType <> 'UNKNOWN' THEN deviceType END, device_type_parsed, 'UNKNOWN') AS deviceType,
    model, channel, claimType, country, status,
    {", ".join(C.DIAGNOSTIC_COLUMNS)}, currency_original,
    CAST(coalesce(class_parsed = 'MANDATORY', false) AS INTEGER) AS is_mandatory_policy,
    coalesce(class_parsed, 'STANDARD') AS policy_class,
    coalesce(payment_parsed, 'UNKNOWN') AS payment_mode,
    coalesce(CAST(duration_parsed AS DOUBLE), CAST(12 AS DOUBLE)) AS contract_duration_months,
    {_finite("excessFee / (rrp + CAST(1e-9 AS DOUBLE))")} AS fee_to_rrp_ratio,
    {_finite("balanceRRP / (rrp + CAST(1e-9 AS DOUBLE))")} AS balance_ratio,
    {_finite("(rrp - balanceRRP) / (rrp + CAST(1e-9 AS DOUBLE))")} AS remaining_balance_ratio,
    {_days('policyEndDate', 'policyStartDate')} AS policy_duration_days,
    CAST(month(policyStartDate) AS BIGINT) AS policy_start_month,
    CAST(year(policyStartDate) AS BIGINT) AS policy_start_year,
    {_days('policyStartDate', 'purchaseDate')} AS days_purchase_to_policy,
    {_count_diag("{c} <> -1")} AS diag_completeness,
    {_count_diag("{c} = 1")} AS diag_ones,
    {_count_diag("{c} = 0")} AS diag_zeros,
    CAST(length(coalesce(issueDesc, '')) AS BIGINT) AS issue_desc_length,
    CAST(len(list_filter(regexp_split_to_array(coalesce(issueDesc, ''), '{PY_WHITESPACE}'),
                         lambda x: x <> '')) AS BIGINT) AS issue_desc_word_count,
    CAST(other IS NOT NULL AS INTEGER) AS has_other_notes
  FROM parsed
)"""

ORDINAL_COLS = C.LABEL_ENCODED + C.EXTRA_ORDINAL
LEVELS = "levels AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS col, coalesce(CAST({c} AS VARCHAR), 'nan') AS level FROM derived"
    for c in C.FREQUENCY_ENCODED + ORDINAL_COLS) + "\n)"

FREQ = f"""freq AS (
  SELECT col, level, count(*) / (SELECT count(*) FROM derived) AS share
  FROM levels WHERE col IN {_in(C.FREQUENCY_ENCODED)} GROUP BY col, level
)"""

ORD = f"""ord AS (
  SELECT col, level, CAST(dense_rank() OVER (PARTITION BY col ORDER BY level) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT col, level FROM levels WHERE col IN {_in(ORDINAL_COLS)})
)"""

FEATURE_NAMES = sorted(
    list(C.DIAGNOSTIC_COLUMNS)
    + ["balanceRRP", "excessFee", "rrp", "balance_ratio", "fee_to_rrp_ratio", "remaining_balance_ratio",
       "contract_duration_months", "is_mandatory_policy", "days_purchase_to_policy",
       "policy_duration_days", "policy_start_month", "diag_completeness", "diag_ones", "diag_zeros",
       "issue_desc_length", "issue_desc_word_count", "has_other_notes"]
    + [f"{c}_freq" for c in C.FREQUENCY_ENCODED] + list(ORDINAL_COLS))

_freq_joins = "\n  ".join(
    f"LEFT JOIN freq f_{c} ON f_{c}.col = '{c}' AND f_{c}.level = coalesce(CAST(d.{c} AS VARCHAR), 'nan')"
    for c in C.FREQUENCY_ENCODED)
_ord_joins = "\n  ".join(
    f"LEFT JOIN ord o_{c} ON o_{c}.col = '{c}' AND o_{c}.level = coalesce(CAST(d.{c} AS VARCHAR), 'nan')"
    for c in ORDINAL_COLS)


def _feature_expr(name: str) -> str:
    if name.endswith("_freq"):
        base = name[:-5]
        return f"coalesce(f_{base}.share, CAST(0 AS DOUBLE)) AS {name}"
    if name in ORDINAL_COLS:
        return f"CAST(coalesce(o_{name}.idx, -1) AS INTEGER) AS {name}"
    return f"d.{name} AS {name}"


MATRIX = f"""matrix AS (
  SELECT d.claim_id, d.claim_key, {", ".join(_feature_expr(n) for n in FEATURE_NAMES)}, d.status
  FROM derived d
  {_freq_joins}
  {_ord_joins}
)"""

CLEAN_CTES = (claims_sql(), CURRENCY, MEDIANS, CLEANED)
FEATURE_CTES = CLEAN_CTES + (PARSED, DERIVED, LEVELS, FREQ, ORD, MATRIX)
