"""Classification and sector roll-up queries."""

from __future__ import annotations

from finfacts.operators import classify as cl
from finfacts.operators import rank, rollup
from finfacts.plans import dims
from finfacts.plans.fixtures import AS_OF, RECENT_FROM
from finfacts.plans.q_rank import metric_oracle
from finfacts.plans.registry import query, sql

R = f"DATE '{RECENT_FROM}'"
_FIX = ["fx_sic", "fx_primary_tickers"]


CLASSIFY_CTES = [
    ("sic", """
SELECT cik, arg_max(CAST(floor(val) AS INTEGER), (end_date, filed, id)) FILTER (val IS NOT NULL) AS sic4,
       arg_max(val_text, (end_date, filed, id)) FILTER (val_text IS NOT NULL) AS described
FROM fx_sic WHERE cik IN (SELECT cik FROM fx_primary_tickers) GROUP BY cik HAVING count(val) > 0"""),
    ("sic_rules", dims.sic_rules_sql()),
    ("by_rule", """
SELECT sic.cik, arg_max(r.sector, r.level) AS sector, arg_max(r.industry, r.level) AS industry
FROM sic JOIN sic_rules r ON r.prefix = sic.sic4 // CASE r.level WHEN 4 THEN 1 WHEN 3 THEN 10 ELSE 100 END
GROUP BY sic.cik"""),
    ("special", dims.overrides_sql()),
    ("by_ticker", """
SELECT cik, max(sector) AS sector, max(industry) AS industry
FROM special JOIN fx_primary_tickers USING (ticker) GROUP BY cik"""),
    ("classified", f"""
SELECT cik, sic4, coalesce(t.sector, r.sector, '{dims.SECTOR_FALLBACK}') AS sector,
       coalesce(t.industry, r.industry, '{dims.INDUSTRY_FALLBACK}') AS industry,
       coalesce(described, 'SIC ' || sic4) AS sub_industry
FROM sic LEFT JOIN by_rule r USING (cik) LEFT JOIN by_ticker t USING (cik)"""),
]


def classified(c):
    """The stored classification table (built once per store, read by the sector queries)."""
    return c["cik_gics"]


@query("classify_industry", "M9 D12 E9 F6 I5 L9",
       sql(_FIX, CLASSIFY_CTES, "SELECT cik, sic4, sector, industry, sub_industry FROM classified"))
def classify_industry(c):
    return cl.classify(c["fx_sic"], c["fx_primary_tickers"], dims.sic_rules_df(c.spark), dims.overrides_df(c.spark))


@query("sector_list", "M11 E6", sql(_FIX, CLASSIFY_CTES, """
SELECT sector, COUNT(*) AS n, sector || ' (' || CAST(COUNT(*) AS VARCHAR) || ')' AS label
FROM classified GROUP BY sector"""))
def sector_list(c):
    return cl.list_sectors(classified(c))


@query("industry_list", "M12 E6", sql(_FIX, CLASSIFY_CTES, """
SELECT sector, industry, COUNT(*) AS n, industry || ' (' || CAST(COUNT(*) AS VARCHAR) || ')' AS label
FROM classified WHERE sector = 'Information Technology' GROUP BY sector, industry"""))
def industry_list(c):
    return cl.list_industries(classified(c), "Information Technology")


def _newest(tag):
    return f"any_value(val) FILTER (tag = '{tag}')"


_MONEY = "DECIMAL(38,4)"    # sums of money don't depend on their order

_FIGURE_CTES = [
    ("newest_items", f"""
SELECT cik, tag, arg_max(s, (period_ending, fiscal_year, fiscal_period, val IS NOT NULL, val)).val AS val
FROM fx_std s WHERE period_ending >= {R} AND frequency = 'annual' GROUP BY cik, tag"""),
    ("figures", f"""
SELECT cik, coalesce({_newest("total_revenue")}, {_newest("operating_revenue")}) AS sales,
       coalesce({_newest("total_cost_of_revenue")}, {_newest("operating_cost_of_revenue")}) AS cost,
       {_newest("net_income")} AS profit, {_newest("total_assets")} AS assets,
       coalesce(sales > 0 AND cost > 0 AND cost / sales >= 0.99, FALSE) AS passes_through
FROM newest_items
WHERE tag IN ('net_income', 'operating_cost_of_revenue', 'operating_revenue', 'total_assets', 'total_cost_of_revenue',
              'total_revenue')
GROUP BY cik"""),
    ("company", f"""
SELECT sector, industry, sub_industry, f.profit, CAST(f.profit AS {_MONEY}) AS profit_sum,
       CAST(if(f.assets > 0, f.assets, 0) AS {_MONEY}) AS asset_sum,
       CAST(if(f.sales > 0 AND NOT f.passes_through, f.sales, 0) AS {_MONEY}) AS sales_sum,
       CASE WHEN f.cik IS NULL THEN NULL WHEN f.sales > 0 AND NOT f.passes_through THEN 1 ELSE 0 END AS sells
FROM classified LEFT JOIN figures f USING (cik)"""),
]


def _totals(keys, where, group):
    return ("totals", f"""
SELECT {keys}, count(*) AS companies, sum(sells) AS sellers, count(profit) AS reporting,
       count(*) FILTER (profit > 0) AS winners, CAST(sum(sales_sum) AS DOUBLE) AS sales,
       coalesce(CAST(sum(profit_sum) AS DOUBLE), 0) AS profits, CAST(sum(asset_sum) AS DOUBLE) AS assets
FROM company WHERE {where} GROUP BY {group}""")


def _agg_oracle(keys, where, group, out="sector, industry, sub_industry"):
    return sql([*_FIX, "fx_std"], [*CLASSIFY_CTES, *_FIGURE_CTES, _totals(keys, where, group)], f"""
SELECT {out}, companies, round(1e2 * sellers / companies, 1) + 0.0 AS with_revenue,
       round(1e2 * winners / nullif(reporting, 0), 1) + 0.0 AS profitable, round(sales) + 0.0 AS total_revenue,
       round(profits) + 0.0 AS total_net_income, round(assets) + 0.0 AS total_assets,
       round(1e2 * profits / nullif(sales, 0), 2) + 0.0 AS aggregate_net_margin,
       round(1e2 * profits / nullif(assets, 0), 2) + 0.0 AS aggregate_roa
FROM totals""")


@query("sector_agg", "M13 E5 E7 F7 D9",
       _agg_oracle("sector, NULL::VARCHAR AS industry, NULL::VARCHAR AS sub_industry", "TRUE", "sector"))
def sector_agg(c):
    return rollup.sector_aggregates(classified(c), c["fx_std"], as_of=AS_OF)


@query("industry_agg", "M13 E8 (sector filter)",
       _agg_oracle("sector, industry, NULL::VARCHAR AS sub_industry", "sector = 'Information Technology'",
                   "sector, industry"))
def industry_agg(c):
    return rollup.sector_aggregates(classified(c), c["fx_std"], sector="Information Technology", as_of=AS_OF)


@query("subindustry_agg", "M13 E8 (industry filter)",
       _agg_oracle("sector, industry, sub_industry", "industry = 'Pharmaceutical Preparations'",
                   "sector, industry, sub_industry"))
def subindustry_agg(c):
    return rollup.sector_aggregates(classified(c), c["fx_std"], industry="Pharmaceutical Preparations", as_of=AS_OF)


@query("sector_rollup", "E8 (GROUPING SETS, one pass)",
       _agg_oracle("sector, industry, sub_industry, grouping(industry) + grouping(sub_industry) AS folded", "TRUE",
                   "ROLLUP (sector, industry, sub_industry) HAVING grouping(sector) = 0",
                   "sector, industry, sub_industry, ['sub_industry', 'industry', 'sector'][folded + 1] AS level"))
def sector_rollup(c):
    return rollup.sector_rollup(classified(c), c["fx_std"], as_of=AS_OF)


@query("sector_medians", "E7 M13 (medians per sector, industry and sub-industry)", sql([*_FIX, "fx_std"], [*CLASSIFY_CTES, *_FIGURE_CTES, ("shares", """
SELECT sector, industry, sub_industry, if(sales_sum > 0, 1e2 * profit / CAST(sales_sum AS DOUBLE), NULL) AS margin,
       if(asset_sum > 0, 1e2 * profit / CAST(asset_sum AS DOUBLE), NULL) AS roa FROM company""")], """
SELECT sector, industry, sub_industry, count(margin) AS with_margin, round(quantile_cont(margin, 0.5), 6) + 0.0 AS median_net_margin,
       count(roa) AS with_roa, round(quantile_cont(roa, 0.5), 6) + 0.0 AS median_roa,
       CASE WHEN grouping(industry) = 1 THEN 'sector' WHEN grouping(sub_industry) = 1 THEN 'industry' ELSE 'sub_industry' END AS level
FROM shares GROUP BY GROUPING SETS ((sector), (sector, industry), (sector, industry, sub_industry))"""))
def sector_medians(c):
    return rollup.sector_medians(classified(c), c["fx_std"], as_of=AS_OF)


@query("top_metric_sector", "M14 M10 (sector filter)",
       metric_oracle("income_statement", "total_revenue", limit=10, extra_fixtures=_FIX, extra_ctes=CLASSIFY_CTES,
                     among="s.cik IN (SELECT cik FROM classified WHERE sector = 'Health Care')"))
def top_metric_sector(c):
    ciks = cl.ciks_in(classified(c), sector="Health Care")
    return rank.top_by_metric(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              "income_statement", "total_revenue", limit=10, ciks=ciks, as_of=AS_OF)
