"""Raw claim table derived from the driver tables (spec: FIXTURES.md §3).

Grain: one claim per order that has at least one line item. Every claim column is a
deterministic rule over the order key ``k``, the customer's nation, the order's
smallest part and one document text, so the same rules can be written once and run
in Spark (``selectExpr``) and in the DuckDB oracle.

Scale notes: the per-order smallest part is a partial (map-side) aggregate of
lineitem before its shuffle; the customer and part joins are left to the planner
(sort-merge at scale, broadcast only when statistics prove a side small, AQE skew
splitting for hot keys). What follows the joins costs far more per row than its bytes
tell, so the narrow base is dealt into tasks by its number of rows before a column is
derived. The document text join is optional because only text features need it, and
those are computed once per document instead (see ``document_text_stats``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope import config as C
from claimscope.session import tasks_for
from claimscope.sources.tables import read_table

# Order priority -> intake channel (5 <-> 5).
_CHANNEL = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Online Portal' WHEN '2-HIGH' THEN 'Email' "
    "WHEN '3-MEDIUM' THEN 'Phone Call' WHEN '4-NOT SPECIFIED' THEN 'Whatsapp' ELSE 'Facebook' END"
)
_CLASS_TOKEN = (
    "CASE k % 5 WHEN 0 THEN '_MANDATORY' WHEN 1 THEN '_VOLUNTARY' WHEN 2 THEN '_DISCOUNT' "
    "WHEN 3 THEN '_EPP' ELSE '' END"
)
_DURATION_TOKEN = (
    "CASE k % 6 WHEN 0 THEN '24M' WHEN 1 THEN '1Y' WHEN 2 THEN '12M' WHEN 3 THEN '6M' "
    "WHEN 4 THEN '3MTHFOC' ELSE '36MTHPID' END"
)
_PAYMENT_TOKEN = "CASE k % 3 WHEN 0 THEN 'MONTHLY' WHEN 1 THEN 'UPFRONT' ELSE 'UPFRONT1Y' END"
_DEVICE_TOKEN = (
    "CASE k % 7 WHEN 0 THEN 'TABLET' WHEN 1 THEN 'LAPTOP' WHEN 2 THEN 'SMARTPHONE' "
    "WHEN 3 THEN 'SMARTPHONES' WHEN 4 THEN 'WEARABLE' WHEN 5 THEN 'EARBUDS' ELSE ' tablets ' END"
)
_DEVICE_STORED = (
    "CASE k % 7 WHEN 0 THEN 'TABLET' WHEN 1 THEN 'LAPTOP' WHEN 2 THEN 'SMARTPHONES' "
    "WHEN 3 THEN 'SMARTPHONES' WHEN 4 THEN 'WEARABLES' WHEN 5 THEN 'EARBUDS' ELSE 'TABLET' END"
)


def _diag(i: int) -> str:
    return (f"CASE WHEN (k + {3 * i}) % 7 = 0 THEN NULL "
            f"ELSE CAST((k + {i}) % 2 AS DOUBLE) END")


def shared_claim_exprs() -> list[tuple[str, str]]:
    """(column, SQL expression) pairs valid in both Spark SQL and DuckDB."""
    exprs = [
        ("claim_key", "k"),
        ("claim_id", "'CLM-' || lpad(CAST(k AS STRING), 9, '0')"),
        ("excessFee", "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(40 + p_size AS DOUBLE) * fx END"),
        ("rrp", "CASE WHEN k % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice * fx END"),
        ("balanceRRP", "CASE WHEN k % 89 = 0 THEN CAST(-50 AS DOUBLE) "
                       "ELSE p_retailprice * fx * CAST(k % 90 + 5 AS DOUBLE) / CAST(100 AS DOUBLE) END"),
        ("oldBalanceRRP", "CASE WHEN k % 89 = 0 THEN CAST(-50 AS DOUBLE) "
                          "ELSE p_retailprice * fx * CAST(k % 90 + 5 AS DOUBLE) / CAST(100 AS DOUBLE) END"),
        ("productName", f"CASE WHEN k % 101 = 0 THEN NULL ELSE country || {_CLASS_TOKEN} || '_ADLD_' "
                        f"|| {_DURATION_TOKEN} || '_' || {_PAYMENT_TOKEN} || '_' || {_DEVICE_TOKEN} END"),
        ("productDesc", "CASE WHEN k % 9 = 0 THEN 'SkÃ¤rmskydd och stÃ¶ldskydd' "
                        "ELSE 'Skärmskydd och stöldskydd' END"),
        ("coverage", "CASE WHEN k % 3 = 0 THEN 'ADLD/THEFT' ELSE 'ADLD' END"),
        ("productCode", "CASE WHEN k % 13 = 0 THEN NULL ELSE p_brand END"),
        ("policyStatus", "CASE WHEN k % 29 = 0 THEN 'Grace Period' WHEN k % 211 = 0 THEN 'InActive' "
                         "ELSE 'Active' END"),
        ("retailerName", "CASE WHEN k % 8 = 0 THEN NULL ELSE 'R' || CAST(k % 7 AS STRING) END"),
        ("deviceType", f"CASE WHEN k % 2 = 0 THEN NULL ELSE {_DEVICE_STORED} END"),
        ("make", "'Generic'"),
        ("model", "p_name"),
        ("deviceCost", "CAST(0 AS INT)"),
        ("relationship", "'Policyholder'"),
        ("channel", _CHANNEL),
        ("claimType", "CASE WHEN k % 17 = 0 THEN 'Theft' WHEN k % 23 = 0 THEN 'Liquid Damage' "
                      "ELSE 'Accidental Damage' END"),
        ("country", "country"),
        ("status", "CASE WHEN (k * 7919) % 100 < 12 + CASE WHEN k % 17 = 0 THEN 8 ELSE 0 END "
                   "+ CASE WHEN k % 29 = 0 THEN 20 ELSE 0 END + CASE WHEN p_size > 40 THEN 10 ELSE 0 END "
                   "THEN 'Declined' ELSE 'Completed' END"),
        ("smashed", "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END"),
        ("frontOrBackCamera", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END"),
        ("other", "CASE WHEN k % 4 = 0 THEN 'note ' || CAST(k % 50 AS STRING) ELSE NULL END"),
    ]
    exprs += [(name, _diag(i)) for i, name in enumerate(C.DIAGNOSTIC_COLUMNS)]
    return exprs


def date_claim_exprs(dialect: str) -> list[tuple[str, str]]:
    if dialect == "spark":
        iso = "date_format({t}, 'yyyy-MM-dd HH:mm:ss')"
        dmy = "date_format({t}, 'dd/MM/yyyy')"
        end = "o_orderdate + INTERVAL 365 DAYS"
        purchase = "timestampadd(DAY, -CAST(k % 30 AS INT), o_orderdate)"
    else:
        iso = "strftime({t}, '%Y-%m-%d %H:%M:%S')"
        dmy = "strftime({t}, '%d/%m/%Y')"
        end = "o_orderdate + INTERVAL 365 DAY"
        purchase = "o_orderdate - to_days(CAST(k % 30 AS INTEGER))"

    def pick(t: str, bad_rule: str = "") -> str:
        return (f"CASE {bad_rule} WHEN k % 2 = 0 THEN {iso.format(t=t)} "
                f"ELSE {dmy.format(t=t)} END")

    return [
        ("policyStartDate", pick("o_orderdate", "WHEN k % 127 = 0 THEN 'unknown'")),
        ("policyEndDate", pick(end)),
        ("purchaseDate", pick(purchase, "WHEN k % 61 = 0 THEN '31/13/2020'")),
    ]


def _claim_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
             .groupBy("l_orderkey").agg(F.min("l_partkey").alias("part_key")))
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    customers = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    parts = read_table(spark, sf_dir, "part",
                       ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"])
    nk = F.col("c_nationkey") % 3
    return (
        orders.join(items, orders.o_orderkey == items.l_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(parts, items.part_key == parts.p_partkey)
        .select(
            F.col("o_orderkey").alias("k"),
            F.when(nk == 1, F.lit(C.SEK_TO_EUR)).otherwise(F.lit(1.0)).alias("fx"),
            F.when(nk == 0, "NL").when(nk == 1, "SE").otherwise("FI").alias("country"),
            "p_retailprice", "p_size", "p_brand", "p_name", "o_orderpriority", "o_orderdate",
        )
    )


def document_count(spark: SparkSession, sf_dir: str):
    """Scalar subquery column: number of documents (claims cycle through them by key)."""
    return read_table(spark, sf_dir, "documents", ["doc_id"]).select(F.count(F.lit(1))).scalar()


def claim_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of some CLAIMS_PER_TASK claims. There is at most one claim per order, and Parquet footers hold the number of orders."""
    return tasks_for(spark, read_table(spark, sf_dir, "orders", ["o_orderkey"]).count(), C.CLAIMS_PER_TASK)


def claim_base(spark: SparkSession, sf_dir: str, by: str = "k") -> DataFrame:
    """The narrow columns that every claim column derives from, with ``doc_key``, dealt by ``by`` into ``claim_tasks``.

    Dealt by a hash of ``k``, since a shuffle by ``k`` itself falls together with the joins' own, which AQE then merges by bytes.
    """
    base = _claim_base(spark, sf_dir).withColumn("doc_key", F.col("k") % document_count(spark, sf_dir))
    return base.repartition(claim_tasks(spark, sf_dir), F.xxhash64("k") if by == "k" else by)


def join_narrative(spark: SparkSession, sf_dir: str, narrow: DataFrame, text=None) -> DataFrame:
    """``narrow`` (rows with ``doc_key``) with the text of their document as ``issueDesc``, joined last, so that texts move once per document.

    ``text`` derives the narrative from a document's text, once per document.
    """
    docs = read_table(spark, sf_dir, "documents", [F.col("doc_id").alias("__doc"), F.col("text").alias("issueDesc")])
    if text is not None:
        docs = docs.withColumn("issueDesc", text("issueDesc"))
    dealt = narrow.repartition(claim_tasks(spark, sf_dir), "doc_key")
    return dealt.join(docs, dealt.doc_key == docs["__doc"], "left").drop("__doc")


def derive_claims(base: DataFrame, *more: str) -> DataFrame:
    """The raw claim columns of base rows, with ``doc_key`` and the columns ``more`` of the base."""
    cols = [f"{expr} AS {name}" for name, expr in shared_claim_exprs() + date_claim_exprs("spark")]
    return base.selectExpr(*cols, "doc_key", *more)


def raw_claims(spark: SparkSession, sf_dir: str, with_text: bool = True, text=None, by: str | None = None) -> DataFrame:
    """The 35 raw claim columns plus ``claim_key`` / ``claim_id`` / ``doc_key``.

    ``text`` derives the narrative from a document's text, once per document instead of once per claim.
    """
    if not with_text:
        return derive_claims(claim_base(spark, sf_dir, by or "k"))
    # the narrow base meets the texts; both are dealt by the document, so no text or wide claim is shuffled twice
    base = _claim_base(spark, sf_dir).withColumn("doc_key", F.col("k") % document_count(spark, sf_dir))
    return derive_claims(join_narrative(spark, sf_dir, base, text), "issueDesc")


def claims_sql(with_text: bool = True) -> str:
    """DuckDB CTE body list (without WITH) defining ``claims``."""
    cols = ",\n    ".join(f"{expr} AS {name}" for name, expr in
                          shared_claim_exprs() + date_claim_exprs("duckdb"))
    text_col = ", d.text AS issueDesc" if with_text else ""
    text_join = "LEFT JOIN documents d ON d.doc_id = b.doc_key" if with_text else ""
    return f"""claim_base AS (
  SELECT o.o_orderkey AS k,
    CASE WHEN c.c_nationkey % 3 = 1 THEN CAST(10.3 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fx,
    CASE c.c_nationkey % 3 WHEN 0 THEN 'NL' WHEN 1 THEN 'SE' ELSE 'FI' END AS country,
    p.p_retailprice, p.p_size, p.p_brand, p.p_name, o.o_orderpriority, o.o_orderdate,
    o.o_orderkey % (SELECT count(*) FROM documents) AS doc_key
  FROM orders o
  JOIN (SELECT l_orderkey, min(l_partkey) AS part_key FROM lineitem GROUP BY l_orderkey) li
    ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN part p ON p.p_partkey = li.part_key
),
claims AS (
  SELECT {cols},
    b.doc_key{text_col}
  FROM claim_base b {text_join}
)"""
