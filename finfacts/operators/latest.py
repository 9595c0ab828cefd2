""""Latest row per key" and period numbering, written for skewed keys.

``latest_by`` is an aggregation (``max`` over a struct whose leading fields are
the sort keys), not a ``row_number`` window: the aggregation runs a partial
(map-side) step before the shuffle, so a company holding a third of all rows is
reduced inside every input task instead of landing whole in one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None,
              descending: bool = True) -> DataFrame:
    """One row per ``keys``: the row with the greatest (or least) ``order`` tuple.

    Ties on ``order`` are broken by the remaining columns, so the pick is
    deterministic. Nulls in an order field lose against values (same as
    ``ORDER BY ... DESC NULLS LAST``) when ``descending``.
    """
    keys = list(keys)
    order = list(order)
    payload = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    rest = [c for c in payload if c not in order]
    fields = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)] + [F.col(c).alias(f"p{i}") for i, c in enumerate(rest)]
    agg = F.max if descending else F.min
    picked = df.groupBy(*keys).agg(agg(F.struct(*fields)).alias("_w"))
    out = [F.col(k) for k in keys]
    out += [F.col(f"_w.o{i}").alias(c) for i, c in enumerate(order) if c in payload]
    out += [F.col(f"_w.p{i}").alias(c) for i, c in enumerate(rest)]
    return picked.select(*out).select(*keys, *payload)


def period_index(df: DataFrame, key, period: str, ascending: bool = True, name: str = "period_idx") -> DataFrame:
    """Dense number of each distinct ``period`` within ``key`` (1 = oldest when ascending).

    The window runs over *distinct* (key, period) pairs, so its partitions hold
    at most one row per reporting period of a company — bounded however many
    facts a company has.
    """
    keys = [key] if isinstance(key, str) else list(key)
    periods = df.select(*keys, period).where(F.col(period).isNotNull()).distinct()
    o = F.col(period).asc() if ascending else F.col(period).desc()
    return periods.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(o)))


def first_n_periods(df: DataFrame, key, period: str, n: int, newest_first: bool = True,
                    name: str = "period_rank") -> DataFrame:
    """Rows of the newest (or oldest) ``n`` periods per key, with their rank; ``n=0`` keeps all."""
    keys = [key] if isinstance(key, str) else list(key)
    idx = period_index(df, keys, period, ascending=not newest_first, name=name)
    if n and n > 0:
        idx = idx.where(F.col(name) <= n)
    return df.join(idx, [*keys, period], "inner")
