"""Text expressions built from Spark built-ins only (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the 27 characters windows-1252 assigns to bytes 0x80-0x9F (0x81, 0x8D,
# 0x8F, 0x90, 0x9D are unassigned), in byte order, and the C1 code points at the same bytes.
CP1252_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E,
                0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)
C1_AT_SAME_BYTES = "".join(chr(b) for b in CP1252_BYTES)

# Python's str.split() whitespace set, spelled for Java and RE2 alike.
PY_WHITESPACE = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

# A character above 127 that begins no UTF-8 sequence where a run of such characters begins, or that stands alone: read as
# windows-1252 bytes, a text that holds one is no UTF-8, so a pass over it changes nothing.
NO_MOJIBAKE_REGEX = r"(?:^|[\x{00}-\x{7F}])(?:[^\x{00}-\x{7F}\x{C2}-\x{F4}]|[^\x{00}-\x{7F}](?:\z|[\x{00}-\x{7F}]))"

# Mojibake markers with "." spelled as "not a newline" so Java and RE2 agree.
MOJIBAKE_REGEX = "Ã[^\\n]|Â[^\\n]|â€"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cp1252_utf8_pass(c: Column) -> Column:
    """One strict pass of "encode as windows-1252, decode as UTF-8"; unchanged on failure."""
    encodable = (~c.rlike(r"[\x{80}-\x{9F}]")) & (
        ~F.translate(c, CP1252_HIGH, "").rlike(r"[^\x{00}-\x{FF}]"))
    as_bytes = F.encode(F.translate(c, CP1252_HIGH, C1_AT_SAME_BYTES), "ISO-8859-1")
    decoded = as_bytes.cast("string")
    return F.when(c.isNull(), c).when(
        encodable & F.is_valid_utf8(F.when(encodable, decoded)), decoded).otherwise(c)


def repair_mojibake(c, max_passes: int = 3) -> Column:
    """Undo UTF-8 text decoded as windows-1252, up to ``max_passes`` times.

    A failing or no-op pass leaves the value as is, and a later pass on the same
    value fails or no-ops again, so a fixed number of passes equals the
    stop-early loop. The passes run as one ``aggregate`` lambda so the pass
    expression appears once in the plan (unrolling would copy the input per pass).
    Text of single-byte characters only is the same in both encodings and needs no pass; nor does text that no pass can decode.
    """
    c = _col(c)
    steps = F.sequence(F.lit(1), F.lit(max_passes))
    return F.when((F.octet_length(c) > F.length(c)) & ~c.rlike(NO_MOJIBAKE_REGEX), F.aggregate(steps, c, lambda acc, _: _cp1252_utf8_pass(acc))).otherwise(c)


def corrupt_as_cp1252(c) -> Column:
    """Inverse, for tests: UTF-8 bytes read as windows-1252 text."""
    latin = F.decode(F.encode(_col(c), "UTF-8"), "ISO-8859-1")
    return F.translate(latin, C1_AT_SAME_BYTES, CP1252_HIGH)


def has_mojibake(c) -> Column:
    return F.coalesce(_col(c).rlike(MOJIBAKE_REGEX), F.lit(False))


def word_count(c) -> Column:
    """Whitespace-separated token count (null/'' -> 0), Python ``len(s.split())``.

    Leading/trailing whitespace is stripped first, so splitting on runs yields exactly
    the non-empty tokens (no lambda: stays inside generated code).
    """
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"^{PY_WHITESPACE}|{PY_WHITESPACE}$", "")
    return F.when(t == F.lit(""), F.lit(0)).otherwise(F.size(F.split(t, PY_WHITESPACE))).cast("long")


def char_length(c) -> Column:
    return F.length(F.coalesce(_col(c), F.lit(""))).cast("long")
