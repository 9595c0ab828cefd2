"""Numeric helpers that behave the same on every engine (ANSI-safe)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(n, d) -> Column:
    """n / d, null when d is 0 or null (ANSI mode raises on 1.0/0)."""
    return _c(n) / F.nullif(_c(d), F.lit(0))


def round_to(x, digits: int) -> Column:
    """``round`` with signed zero folded to +0.0 (engines differ on ``round(-0.001, 2)``)."""
    return F.round(_c(x), digits) + F.lit(0.0)


def ratio_pct(n, d, digits: int = 2) -> Column:
    """``round(n / d * 100, 2)`` as in the ratio ranking."""
    return round_to(safe_div(n, d) * 100, digits)


def growth(cur, prior, digits: int = 4) -> Column:
    """``round((v - p) / |p|, 4)``; null when the prior value is null or zero."""
    p = _c(prior)
    return F.when(p.isNotNull() & (p != 0) & _c(cur).isNotNull(),
                  round_to((_c(cur) - p) / F.abs(p), digits))


def exact_sum(x, scale: int = 4) -> Column:
    """Order-independent sum of money held as double.

    Statement values carry at most ``scale`` decimals, so summing them as DECIMAL
    is exact; a double sum would depend on the order partitions arrive in.
    """
    return F.sum(_c(x).cast(f"decimal(38,{scale})")).cast("double")
