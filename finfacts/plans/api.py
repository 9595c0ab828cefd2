"""User-facing entry points over a store of DataFrames (the reference's read API, in bulk form)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from finfacts.operators import classify as cl
from finfacts.operators import rank
from finfacts.plans import dims


def top_companies(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, rates: DataFrame,
                  classified: DataFrame | None, metric: str = "income_statement|total_revenue", limit: int = 25,
                  sector: str | None = None, industry: str | None = None, as_of=None) -> DataFrame:
    """Ranking for any catalogue spec: ``statement|tag``, ``statement|a+b``, ``statement|a/b`` or a
    named ratio, optionally within a sector / industry (no match -> empty ranking)."""
    if not 1 <= int(limit) <= 100:
        raise ValueError("limit must be between 1 and 100")
    ciks = cl.ciks_in(classified, sector, industry) if (sector or industry) and classified is not None else None
    p = dims.parse_metric(metric)
    kind = p.pop("kind")
    if kind == "ratio":
        return rank.top_by_ratio(std, companies, primary_tickers, limit=limit, ciks=ciks, as_of=as_of, **p)
    if kind == "sum":
        return rank.top_by_sum(std, companies, primary_tickers, rates, p["statement"], p["tag_a"], p["tag_b"],
                               limit=limit, ciks=ciks, as_of=as_of)
    return rank.top_by_metric(std, companies, primary_tickers, rates, p["statement"], p["tag"], limit=limit,
                              exclude_financial=p["exclude_financial"], frequency=p["frequency"],
                              negate=p["negate"], ciks=ciks, as_of=as_of)
