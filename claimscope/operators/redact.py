"""Schema-driven PII redaction at any nesting depth (structs and arrays of structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import config as C


def _redact(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[
            (F.lit(C.REDACTED) if f.name.lower() in C.PII_KEYS else _redact(col[f.name], f.dataType)).alias(f.name)
            for f in dtype.fields])
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _redact(x, dtype.elementType))
    return col


def redact(df: DataFrame) -> DataFrame:
    """Values under PII keys (case-insensitive) become '[REDACTED]'; everything else is kept."""
    return df.select(*[
        (F.lit(C.REDACTED) if f.name.lower() in C.PII_KEYS else _redact(F.col(f.name), f.dataType)).alias(f.name)
        for f in df.schema.fields])
