"""Parsing expressions: mixed-format dates, product-name tokens, numbers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope import config as C

# ISO datetimes and day-first dates share one column; month-first is never tried.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_mixed_date(c, formats=DATE_FORMATS) -> Column:
    """First format that parses wins; anything else becomes null.

    A failed parse costs far more than a good one, so a format is tried only on text that holds its separators and no other of
    ``/`` and ``:``, which no number can take up.
    """
    s = F.trim(_col(c).cast("string"))

    def fits(fmt):
        needed = [s.contains(sep) for sep in "/:-" if sep in fmt]
        foreign = [~s.contains(sep) for sep in "/:" if sep not in fmt]
        return reduce(and_, needed + foreign)

    return F.coalesce(*[F.when(fits(fmt), F.try_to_timestamp(s, F.lit(fmt))) for fmt in formats])


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def product_tokens(c) -> Column:
    return F.transform(F.split(_col(c), "_"), lambda t: F.upper(F.trim(t)))


def _first_in(tokens: Column, mapping: Column) -> Column:
    hits = F.filter(tokens, lambda t: F.map_contains_key(mapping, t))
    return F.element_at(mapping, F.get(hits, 0))


def parse_product_name(c) -> Column:
    """Struct of the four signals in a product code, matched by membership (F1).

    Null or blank names give all-null fields. The tokens are bound by a lambda, so a name is cut once for all four signals.
    """
    name = _col(c)
    blank = name.isNull() | (F.trim(name) == F.lit(""))
    classes = F.array(*[F.lit(t) for t in C.POLICY_CLASS_TOKENS])

    def signals(tokens):
        fields = {
            "device_type_parsed": _first_in(tokens, _literal_map(C.DEVICE_TOKENS)),
            "payment_mode": _first_in(tokens, _literal_map(C.PAYMENT_TOKENS)),
            "contract_duration_months": _first_in(
                tokens, _literal_map({k: int(v) for k, v in C.DURATION_TOKENS.items()})).cast("int"),
            "policy_class": F.get(F.filter(tokens, lambda t: F.array_contains(classes, t)), 0),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    return F.get(F.transform(F.array(F.when(~blank, product_tokens(name))), signals), 0)


def to_number(c) -> Column:
    """Coerce to double, bad text -> null (ANSI-safe)."""
    return _col(c).try_cast("double")
