"""Column functions for identifiers, dates and numbers (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_cik(x) -> Column:
    """Trim, strip leading zeros, left-pad to 10 digits; non-digits -> null.

    ``lpad`` truncates longer strings, so identifiers of more than 10 digits are
    kept as they are instead of being cut.
    """
    s = F.trim(_c(x).cast("string"))
    digits = F.regexp_replace(s, r"^0+", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    ok = s.isNotNull() & (s != "") & digits.rlike(r"^[0-9]+$")
    return F.when(ok, F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0")))


def normalize_ticker(x) -> Column:
    """Upper case, ``.`` -> ``-`` (BRK.B -> BRK-B)."""
    return F.translate(F.upper(_c(x)), ".", "-")


def strict_date(x) -> Column:
    """Exactly ``YYYY-MM-DD`` -> date; anything else, also with blanks or a time, -> null."""
    s = _c(x).cast("string")
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(s, "yyyy-MM-dd"))


def to_double_or_null(x) -> Column:
    """Python-``float()``-like coercion of a JSON scalar held as text; otherwise null."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def to_int_or_null(x) -> Column:
    """``int()``-like coercion: integer text, also one like ``2024.0`` -> int, else null."""
    s = F.regexp_replace(F.trim(_c(x).cast("string")), r"\.0*$", "")
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def sic4(x) -> Column:
    """Numeric SIC code -> int, truncating any fraction (``floor``; casts differ by engine)."""
    return F.floor(_c(x)).cast("int")


def sic4_text(x) -> Column:
    """Int SIC code -> 4-character text with leading zeros."""
    return F.lpad(_c(x).cast("string"), 4, "0")
