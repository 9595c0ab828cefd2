"""Label and text helpers for statement shaping and provenance (pure Column exprs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field-name acronyms kept upper/mixed case when humanising a
# snake_case line item (must match the reference's output labels).
ACRONYMS = {
    "ppe": "PPE", "nci": "NCI", "aoci": "AOCI", "ttm": "TTM", "yoy": "YoY", "pop": "PoP",
    "usd": "USD", "us": "US", "ifrs": "IFRS", "gaap": "GAAP", "eps": "EPS", "ebit": "EBIT",
    "ebitda": "EBITDA", "fy": "FY", "ar": "AR", "ap": "AP", "sga": "SG&A", "rd": "R&D", "os": "OS",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _acronym_map() -> Column:
    return F.create_map(*[F.lit(v) for kv in sorted(ACRONYMS.items()) for v in kv])


def capitalize(x) -> Column:
    """First character upper, the rest lower (Python ``str.capitalize``)."""
    s = _c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def humanize(x) -> Column:
    """``net_income`` -> ``Net Income``; ``purchase_of_ppe`` -> ``Purchase Of PPE``."""
    m = _acronym_map()
    parts = F.split(_c(x), "_")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(m[p], capitalize(p))), " ")


def squash_spaces(x) -> Column:
    """Python ``" ".join(s.split())``: trim and collapse whitespace runs."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def _derived_field(norm: Column) -> Column:
    body = F.trim(F.regexp_extract(norm, r"^[^:]*:(.*)$", 1))
    return F.trim(F.regexp_extract(body, r"^([^(]*)", 1))


def source_group_key(x) -> Column:
    """Grouping key for provenance runs: ``derived:<field>`` or the normalised text."""
    norm = squash_spaces(x)
    is_derived = F.lower(norm).startswith("derived:")
    field = _derived_field(norm)
    return F.when(is_derived & (field != ""), F.concat(F.lit("derived:"), F.lower(field))) \
        .when(is_derived, F.lit("derived")).otherwise(norm)


def source_label(x) -> Column:
    """Human-readable provenance label for a source string."""
    norm = squash_spaces(x)
    is_derived = F.lower(norm).startswith("derived:")
    field = _derived_field(norm)
    fallback_base = F.trim(F.replace(norm, F.lit("(fallback)"), F.lit("")))
    return (F.when(is_derived & (field != ""), F.concat(F.lit("derived from prior period "), humanize(field)))
            .when(is_derived, F.lit("derived from prior period"))
            .when(norm.contains("(fallback)"),
                  F.concat(fallback_base, F.lit(" (tag sourced from filing vintage other than original)")))
            .otherwise(norm))


def fiscal_year_label(x) -> Column:
    return F.when(_c(x).isNotNull(), F.concat(F.lit("FY"), _c(x).cast("int").cast("string")))


def period_label(fp, period_ending) -> Column:
    """Transposed column header ``"<fp> <yyyy-mm-dd>"`` (trimmed)."""
    return F.trim(F.concat_ws(" ", F.coalesce(_c(fp), F.lit("")),
                              F.coalesce(F.date_format(_c(period_ending), "yyyy-MM-dd"), F.lit(""))))
