"""Number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def general(x: Column) -> Column:
    """A double as C's and Python's ``g``: 6 significant digits without trailing zeros, exponents below -4 and from 6 on."""
    sci = F.format_string("%.5e", F.abs(x))                     # d.ddddde+XX
    mantissa = F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", "")
    exponent = F.substring_index(sci, "e", -1)
    plain = F.regexp_replace(sci.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    body = (F.when(x == 0, F.lit("0")).when(F.abs(x) == float("inf"), F.lit("inf"))
            .when(exponent.cast("int").between(-4, 5), plain)
            .otherwise(F.concat(mantissa, F.lit("e"), exponent)))
    return F.when(F.isnan(x), F.lit("nan")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body))
