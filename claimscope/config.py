"""Constants for every operator, in one place.

Everything under a "FIXED VALUES" banner must equal the behaviour being
re-implemented (thresholds, dictionaries, word lists, patterns). The rest are
defaults of this library that callers may override per call.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: cleaning
# ---------------------------------------------------------------------------
TARGET = "status"
POSITIVE_CLASS = "Declined"
TARGET_CLASSES = ("Completed", "Declined")

SEK_TO_EUR = 10.3
SEK_COUNTRIES = ("SE",)
AMOUNT_COLUMNS = ("rrp", "excessFee", "balanceRRP")

DROP_CONSTANT = ("deviceCost", "relationship", "make")
DROP_DUPLICATE = ("oldBalanceRRP",)
DROP_DEGENERATE = ("smashed", "frontOrBackCamera")
DROP_REDUNDANT_TEXT = ("productDesc",)
HOLD_OUT_TEXT = ("issueDesc", "other")
TEXT_COLUMNS = ("issueDesc", "other", "productDesc", "model")

DATE_COLUMNS = ("policyStartDate", "policyEndDate", "purchaseDate")

DIAGNOSTIC_SENTINEL = -1
DIAGNOSTIC_COLUMNS = (
    "turnOnOff", "touchScreen", "frontCamera", "backCamera", "audio",
    "mic", "buttons", "connection", "charging",
)
CATEGORICAL_FILL = "UNKNOWN"
CATEGORICAL_COLUMNS = ("deviceType", "retailerName", "productCode")

# The 35 columns of a raw claim, in source order.
EXPECTED_COLUMNS = (
    "excessFee", "rrp", "balanceRRP", "oldBalanceRRP", "productName", "productDesc",
    "coverage", "productCode", "policyStartDate", "policyEndDate", "policyStatus",
    "retailerName", "deviceType", "make", "model", "purchaseDate", "deviceCost",
    "relationship", "channel", "claimType", "country", "status", "turnOnOff",
    "touchScreen", "smashed", "frontCamera", "backCamera", "frontOrBackCamera",
    "audio", "mic", "buttons", "connection", "charging", "other", "issueDesc",
)

# FIXED VALUES: marks of text that was decoded as cp1252.

# ---------------------------------------------------------------------------
# FIXED VALUES: product-name dictionaries (token -> stored form)
# ---------------------------------------------------------------------------
DEVICE_TOKENS = {
    "SMARTPHONE": "SMARTPHONES",
    "SMARTPHONES": "SMARTPHONES",
    "TABLET": "TABLET",
    "TABLETS": "TABLET",
    "LAPTOP": "LAPTOP",
    "WEARABLE": "WEARABLES",
    "WEARABLES": "WEARABLES",
    "EARBUDS": "EARBUDS",
}
PAYMENT_TOKENS = {
    "MONTHLY": "MONTHLY",
    "UPFRONT": "UPFRONT",
    "UPFRONT1Y": "UPFRONT",
    "UPFRONT2Y": "UPFRONT",
}
DURATION_TOKENS = {
    "3MTHFOC": 3,
    "6M": 6,
    "6MTHFOC": 6,
    "12M": 12,
    "1Y": 12,
    "12MTHFOC": 12,
    "UPFRONT1Y": 12,
    "24M": 24,
    "UPFRONT2Y": 24,
    "36MTHPID": 36,
}
POLICY_CLASS_TOKENS = ("MANDATORY", "VOLUNTARY", "DISCOUNT", "EPP")
DEFAULT_POLICY_CLASS = "STANDARD"
DEFAULT_DURATION_MONTHS = 12

FREQUENCY_ENCODED = ("model", "productCode", "retailerName")
LABEL_ENCODED = ("claimType", "coverage", "country", "channel", "policyStatus", "deviceType")
EXTRA_ORDINAL = ("policy_class", "payment_mode")
NON_FEATURE_COLUMNS = ("currency_original", "policy_start_year")
ABSOLUTE_AMOUNTS = ("rrp", "excessFee", "balanceRRP")
RATIO_EPS = 1e-9

# ---------------------------------------------------------------------------
# FIXED VALUES: claim contract (request validation)
# ---------------------------------------------------------------------------
ENUMS = {
    "claimType": ("Accidental Damage", "Theft", "Liquid Damage"),
    "country": ("NL", "SE", "FI"),
    "coverage": ("ADLD", "ADLD/THEFT"),
    "policyStatus": ("Active", "Grace Period", "InActive"),
    "channel": ("Online Portal", "Email", "Phone Call", "Whatsapp", "Facebook"),
}
REQUIRED_FIELDS = (
    "rrp", "balanceRRP", "coverage", "productName", "policyStartDate", "policyEndDate",
    "purchaseDate", "policyStatus", "channel", "claimType", "country", "issueDesc",
)
CONTRACT_DIAGNOSTICS = DIAGNOSTIC_COLUMNS + ("smashed", "frontOrBackCamera")
REQUEST_FIELDS = tuple(c for c in EXPECTED_COLUMNS if c != TARGET) + ("claim_id",)

PII_KEYS = ("issuedesc", "issue_desc", "other", "customer_name", "email", "phone", "imei")
REDACTED = "[REDACTED]"

# ---------------------------------------------------------------------------
# FIXED VALUES: human-review gate and risk flags
# ---------------------------------------------------------------------------
STRAIGHT_THROUGH_BELOW = 0.30
MANDATORY_REVIEW_ABOVE = 0.70
HIGH_VALUE_RRP_EUR = 2500.0
MIN_DIAG_COMPLETENESS = 3
DECISION_STRAIGHT_THROUGH = "straight-through processing candidate"
DECISION_UNDER_REVIEW = "under review"
DECISION_EXPERT_REVIEW = "mandatory expert review"
OUTCOME_NO_REVIEW = (
    "NO ADVERSE DECISION HAS BEEN ISSUED. This claim is eligible for the "
    "straight-through queue. That is a routing outcome, not an approval."
)
OUTCOME_REVIEW = (
    "NO DECISION HAS BEEN ISSUED — the claim is NOT declined and NOT approved. "
    "The score exceeding the threshold routes this claim to a human reviewer; "
    "it is not itself a decision. Any adverse outcome requires a human."
)

# ---------------------------------------------------------------------------
# FIXED VALUES: personas
# ---------------------------------------------------------------------------
PERSONAS = {
    "customer": dict(top_n=5, show_score=False, show_shap_values=False, show_next_steps=True,
                     show_risk_flags=False, include_issue_desc=False, require_versions=False,
                     tone="empathetic, clear, non-accusatory", reading_level="simple"),
    "adjuster": dict(top_n=10, show_score=True, show_shap_values=True, show_next_steps=False,
                     show_risk_flags=True, include_issue_desc=True, require_versions=False,
                     tone="professional, factual, analytical", reading_level="standard"),
    "auditor": dict(top_n=15, show_score=True, show_shap_values=True, show_next_steps=False,
                    show_risk_flags=True, include_issue_desc=True, require_versions=True,
                    tone="formal, compliance-oriented", reading_level="standard"),
}
PLAIN_SUMMARY_FIELDS = ("claimType", "deviceType", "coverage", "policyStatus")
TECHNICAL_SUMMARY_FIELDS = PLAIN_SUMMARY_FIELDS + (
    "country", "channel", "rrp", "excessFee", "balanceRRP", "productCode", "policy_class",
)
CUSTOMER_INCREASING = 3
CUSTOMER_DECREASING = 2

# ---------------------------------------------------------------------------
# FIXED VALUES: output validation
# ---------------------------------------------------------------------------
RESPONSE_REQUIRED_FIELDS = {
    "customer": ("summary", "key_factors", "next_steps"),
    "adjuster": ("summary", "key_factors", "risk_assessment", "review_notes"),
    "auditor": ("summary", "key_factors", "provenance_record", "human_oversight", "limitations"),
}
CUSTOMER_BLOCKLIST = (
    "shap", "shapley", "probability", "confidence score", "model predicts", "threshold",
    "random forest", "xgboost", "catboost", "lightgbm", "llama", "gpt", "gemini", "groq",
    "feature importance", "classifier", "training data", "base rate", "attribution",
    "algorithm", "machine learning", "decline risk score",
)
FORBIDDEN_EVERYWHERE = ("auto-approved", "automatically approved", "auto-declined")
GROUNDING_MIN_MAGNITUDE = 10.0
GROUNDING_TOLERANCE = 0.01
MAX_RETRIES_ON_FAILURE = 1

# FIXED VALUES: assertion patterns, matched on the lower-cased response text.
DECLINED_ASSERTIONS = (
    r"\b(?:was|is|has been|been|being)\s+(?:declined|rejected|refused|denied|turned down)\b"
    r"|\bwe\s+(?:have\s+)?(?:declined|rejected|refused|denied)\b"
    r"|\byour claim (?:was|is|has been)\s+(?:declined|rejected|refused|denied)\b"
)
FINALITY_ASSERTIONS = (
    r"\b(?:final decision (?:has been|was) made|decision is final|claim (?:is|has been) "
    r"(?:settled|closed|finalised|finalized)|has been approved|was approved)\b"
)
REVIEWED_ASSERTIONS = (
    r"\b(?:has been|was) reviewed by (?:a|an|our)\s+\w+"
    r"|\ban? (?:adjuster|expert|human) (?:has|already) reviewed\b"
)
PROMISED_REVIEW = (
    r"\bwill be (?:reviewed|assessed|examined|looked at)\b"
    r"|\b(?:someone|somebody|our team|a (?:team member|colleague|specialist|person)"
    r"|an? (?:adjuster|expert|agent|assessor)) will (?:review|look at|assess|examine|check)\b"
)
# Numbers that stand alone; either decimal mark.
NUMBER_TOKEN = r"(^|[^A-Za-z0-9\-])(-?\d+(?:[.,]\d+)?)"

# FIXED VALUES: sentences of the template explanation.
TEMPLATE_UNDER_REVIEW = "is currently under review by our team"
TEMPLATE_PROCESSED = "has been processed and is moving through our standard handling"
TEMPLATE_KEY_FACTOR = "A detailed explanation is temporarily unavailable."
TEMPLATE_NEXT_STEP = "Contact support if you need an update on this claim."
TEMPLATE_RISK = "Narrative explanation unavailable; review the factor list."
TEMPLATE_REVIEW_NOTES = "Assess this claim from the attribution data directly."
TEMPLATE_PROVENANCE = "See the structured decision record accompanying this claim."
TEMPLATE_LIMITATIONS = "Generated explanation unavailable for this decision."

# ---------------------------------------------------------------------------
# FIXED VALUES: drift
# ---------------------------------------------------------------------------
PSI_WATCH = 0.10
PSI_ALARM = 0.20
PSI_N_BINS = 10
PSI_MIN_ROWS = 200
PSI_IGNORE = ("issue_desc_length", "issue_desc_word_count")
CATEGORICAL_MAX_CARDINALITY = 12
SCORE_FEATURE = "decline_risk_score"

# ---------------------------------------------------------------------------
# FIXED VALUES: call-ledger health
# ---------------------------------------------------------------------------
MONTHLY_BUDGET_USD = 20.0
ALERT_AT_BUDGET_FRACTION = 0.80
FALLBACK_RATE_ALARM = 0.10
TEMPLATE_FALLBACK_ALARM = 0.01
LATENCY_P95_LIMIT_MS = 5000.0
MIN_CALLS_FOR_PERCENTILE = 20
WARN_FRACTION = 0.8
DEFAULT_WINDOW_HOURS = 720
LEDGER_REQUIRED_KEYS = ("timestamp", "persona", "provider", "model", "latency_ms")
LEDGER_FIELDS = (
    "timestamp", "persona", "provider", "model", "latency_ms", "prompt_tokens",
    "completion_tokens", "cost_usd", "used_fallback_provider", "used_template_fallback",
    "retried", "validation_passed", "is_mock",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: evaluation
# ---------------------------------------------------------------------------
N_FOLDS = 5
INNER_FOLDS = 3
RANDOM_STATE = 42
THRESHOLD_RANGE = (0.05, 0.95)
THRESHOLD_STEP = 0.01
ROUTING_BANDS = ((-0.01, 0.30, "low"), (0.30, 0.70, "mid"), (0.70, 1.01, "high"))
THIN_CELL_N = 50
TOP_CANDIDATES = 3
SAMPLE_ROWS = 400

# Request throttle: limit per 60 s window per (client, path).
THROTTLE_WINDOW_S = 60.0
THROTTLE_LIMITS = {"/api/v1/predict": 100, "/api/v1/explain": 20}

# ---------------------------------------------------------------------------
# FIXED VALUES: feature labels (technical, label, plain wording, unit)
# ---------------------------------------------------------------------------
FEATURE_LABELS = (
    ("rrp", "Device value (RRP, EUR)", "the value of your device", "EUR"),
    ("excessFee", "Excess fee (EUR)", "the excess on your policy", "EUR"),
    ("balanceRRP", "Outstanding device balance (EUR)", "the amount still owed on your device", "EUR"),
    ("fee_to_rrp_ratio", "Excess as a share of device value",
     "how large your excess is compared with the device's value", ""),
    ("balance_ratio", "Outstanding balance as a share of device value",
     "how much of your device's value is still outstanding", ""),
    ("remaining_balance_ratio", "Share of device value already paid",
     "how much of your device you have already paid off", ""),
    ("policyStatus", "Policy status", "the status of your policy", ""),
    ("coverage", "Coverage type", "the cover included in your policy", ""),
    ("policy_class", "Policy class (mandatory / voluntary / discount)", "the type of policy you hold", ""),
    ("is_mandatory_policy", "Mandatory policy", "the type of policy you hold", ""),
    ("payment_mode", "Payment mode (monthly / upfront)", "how your policy is paid", ""),
    ("contract_duration_months", "Contract length", "the length of your cover", "months"),
    ("policy_duration_days", "Policy duration", "how long your policy runs", "days"),
    ("days_purchase_to_policy", "Days between device purchase and policy start",
     "how long after buying the device the cover started", "days"),
    ("policy_start_month", "Policy start month", "when your cover began", ""),
    ("claimType", "Claim type", "the type of damage reported", ""),
    ("channel", "Submission channel", "how the claim was submitted", ""),
    ("country", "Country", "the country your policy is held in", ""),
    ("deviceType", "Device category", "the kind of device covered", ""),
    ("turnOnOff", "Power-on diagnostic", "whether the device powers on", ""),
    ("touchScreen", "Touchscreen diagnostic", "the condition of the screen", ""),
    ("frontCamera", "Front camera diagnostic", "the condition of the front camera", ""),
    ("backCamera", "Rear camera diagnostic", "the condition of the rear camera", ""),
    ("audio", "Audio diagnostic", "whether sound works", ""),
    ("mic", "Microphone diagnostic", "whether the microphone works", ""),
    ("buttons", "Buttons diagnostic", "the condition of the buttons", ""),
    ("connection", "Connectivity diagnostic", "whether the device connects", ""),
    ("charging", "Charging diagnostic", "whether the device charges", ""),
    ("diag_completeness", "Number of diagnostic checks performed",
     "how many checks were carried out on your device", ""),
    ("diag_ones", "Diagnostic checks returning 1", "the results of the checks on your device", ""),
    ("diag_zeros", "Diagnostic checks returning 0", "the results of the checks on your device", ""),
    ("issue_desc_length", "Length of the reported description", "the description you provided",
     "characters"),
    ("issue_desc_word_count", "Word count of the reported description",
     "the description you provided", "words"),
    ("has_other_notes", "Additional notes provided", "the extra notes you provided", ""),
    ("model_freq", "Device model frequency in the portfolio", "how common your device model is", ""),
    ("productCode_freq", "Product code frequency in the portfolio", "how common your policy type is", ""),
    ("retailerName_freq", "Retailer frequency in the portfolio", "where the device was purchased", ""),
)

# Engineered features named in the importance report (share of top-15 SHAP mass).
ENGINEERED_FEATURES = (
    "fee_to_rrp_ratio", "balance_ratio", "remaining_balance_ratio",
    "contract_duration_months", "is_mandatory_policy", "payment_mode",
    "diag_completeness", "diag_ones", "diag_zeros",
    "issue_desc_length", "issue_desc_word_count",
    "policy_duration_days", "days_purchase_to_policy",
)

# Library defaults (not reference values).
MAX_BROADCAST_ROWS = 2_000_000
CLAIMS_PER_TASK = 25_000      # derived columns, contexts and responses of a claim cost by the row
