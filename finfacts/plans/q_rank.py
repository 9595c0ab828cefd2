"""Ranking queries (M14-M17, D6, F1, F4) over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.operators import asof, rank
from finfacts.operators.asof import asof_pairs
from finfacts.operators.latest import latest_by
from finfacts.plans import dims
from finfacts.plans.fixtures import AS_OF, RECENT_FROM
from finfacts.plans.registry import query, sql

R = f"DATE '{RECENT_FROM}'"

# The oracles are written in DuckDB's own idioms (arg_max over whole rows, ASOF and ANTI joins), independent of the
# operators' plans. One row of ``catalogue`` stands for one metric, so single rankings and the full list share a text.
_INPUTS = ["fx_std", "fx_rates", "fx_companies", "fx_primary_tickers"]

BEST_TICKER = ("best_ticker", """
SELECT cik, arg_min(ticker, (coalesce(rank, 2147483647), ticker)) AS ticker FROM fx_primary_tickers GROUP BY cik""")

USD_RATES = ("usd_rates", """
SELECT from_currency AS currency, rate_date, max(rate) AS rate FROM fx_rates WHERE to_currency = 'USD' GROUP BY ALL""")


def _in_usd(src: str, name: str = "in_usd") -> tuple[str, str]:
    """``src`` with the factor to US dollars on or before its period; rows without a rate have none."""
    return (name, f"""
SELECT x.*, CASE x.currency WHEN 'USD' THEN 1.0::DOUBLE ELSE r.rate END AS factor
FROM {src} x ASOF LEFT JOIN usd_rates r ON x.currency = r.currency AND x.period_ending >= r.rate_date""")


def _metric_ctes(catalogue: str, among: str = "TRUE") -> list[tuple[str, str]]:
    """``ranked``: every company's newest value of each metric, in US dollars, without pass-through sales."""
    return [
        ("catalogue", catalogue),
        ("newest", f"""
SELECT k.metric, k.negate, k.exclude_financial, s.cik,
       arg_max(s, (s.period_ending, s.fiscal_year, s.fiscal_period, s.val)) AS r
FROM fx_std s JOIN catalogue k ON s.statement = k.statement AND s.tag = k.tag
WHERE s.frequency = coalesce(k.frequency, s.frequency) AND s.period_ending >= {R} AND s.val IS NOT NULL AND {among}
GROUP BY ALL"""),
        ("eligible", """
SELECT metric, cik, r.period_ending, r.fiscal_year, r.fiscal_period, r.currency, if(negate, -r.val, r.val) AS amount
FROM newest n ANTI JOIN fx_std cost
  ON n.r.statement = 'income_statement' AND n.r.tag IN ('total_revenue', 'operating_revenue') AND n.r.val > 0
 AND cost.statement = 'income_statement' AND cost.tag IN ('total_cost_of_revenue', 'operating_cost_of_revenue')
 AND cost.frequency = 'annual' AND cost.val > 0 AND cost.val / n.r.val >= 0.99
 AND cost.cik = n.cik AND cost.period_ending = n.r.period_ending
 AND cost.fiscal_year = n.r.fiscal_year AND cost.fiscal_period = n.r.fiscal_period
WHERE if(negate, r.val < 0, TRUE) AND if(exclude_financial, r.company_type NOT IN ('financial', 'insurance'), TRUE)"""),
        USD_RATES,
        _in_usd("eligible"),
        BEST_TICKER,
        ("ranked", """
SELECT * EXCLUDE (entity_name, period_ending, amount, factor), coalesce(entity_name, '') AS name,
       strftime(period_ending, '%Y-%m-%d') AS period_ending, amount * factor AS value
FROM (SELECT cik, entity_name FROM fx_companies) JOIN best_ticker USING (cik) JOIN in_usd USING (cik)
WHERE factor IS NOT NULL"""),
    ]


def metric_oracle(statement, tag, limit=25, exclude_fin=True, frequency="annual", negate=False, among="TRUE",
                  extra_fixtures=(), extra_ctes=()):
    one = dims.values_sql([("one", statement, tag, frequency, negate, exclude_fin)],
                          ["metric", "statement", "tag", "frequency", "negate", "exclude_financial"],
                          ["VARCHAR"] * 4 + ["BOOLEAN"] * 2)
    return sql([*_INPUTS, *extra_fixtures], [*extra_ctes, *_metric_ctes(one, among)],
               f"SELECT * EXCLUDE (metric) FROM ranked ORDER BY value DESC, cik LIMIT {limit}")


@query("top_metric_usd", "M14 C1 C2 C3 C4 F1 E3 D8 D6 G1 F4",
       metric_oracle("income_statement", "total_revenue"))
def top_metric_usd(c):
    return rank.top_by_metric(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              "income_statement", "total_revenue", limit=25, as_of=AS_OF)


@query("top_metric_negated", "M14 C5", metric_oracle("balance_sheet", "total_assets", negate=True))
def top_metric_negated(c):
    return rank.top_by_metric(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              "balance_sheet", "total_assets", limit=25, negate=True, as_of=AS_OF)


@query("top_metric_any_frequency", "M14 7.2.1",
       metric_oracle("balance_sheet", "total_assets", limit=50, frequency=None))
def top_metric_any_frequency(c):
    # Balance-sheet metrics rank with frequency=None: annual and quarterly rows mix,
    # ties at one period_ending resolved by fiscal_year, fiscal_period, val.
    return rank.top_by_metric(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              "balance_sheet", "total_assets", limit=50, frequency=None, as_of=AS_OF)


@query("top_metric_net_income", "M14 (financial templates kept)",
       metric_oracle("income_statement", "net_income", limit=40, exclude_fin=False))
def top_metric_net_income(c):
    return rank.top_by_metric(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              "income_statement", "net_income", limit=40, exclude_financial=False, as_of=AS_OF)


def _pair_ctes(first, second, first_where="TRUE", second_where="TRUE") -> list[tuple[str, str]]:
    """``pair``: each company's newest annual period with both items; ``a`` is the first's row, ``b`` the second's value."""
    best = "(fiscal_year, fiscal_period, val)"

    def item(x):
        return f"statement = '{x[0]}' AND tag = '{x[1]}'"
    return [
        ("by_period", f"""
SELECT cik, period_ending, arg_max(s, {best}) FILTER ({item(first)} AND {first_where}) AS a,
       arg_max(val, {best}) FILTER ({item(second)}) AS b
FROM fx_std s WHERE val IS NOT NULL AND frequency = 'annual' AND period_ending >= {R} GROUP BY ALL"""),
        ("pair", f"""
SELECT cik, max(period_ending) AS period_ending, arg_max(a, period_ending) AS a, arg_max(b, period_ending) AS b
FROM by_period WHERE a IS NOT NULL AND b IS NOT NULL AND {second_where} GROUP BY cik"""),
    ]


def _named(src: str, cols: str, limit: int) -> str:
    return f"""
SELECT cik, ticker, coalesce(entity_name, '') AS name, strftime(period_ending, '%Y-%m-%d') AS period_ending, {cols}, value
FROM {src} JOIN (SELECT cik, entity_name FROM fx_companies) USING (cik) JOIN best_ticker USING (cik)
ORDER BY value DESC, cik LIMIT {limit}"""


def _sum_oracle(statement, first, second, limit=25, exclude_fin=True):
    kept = "a.company_type NOT IN ('financial', 'insurance')" if exclude_fin else "TRUE"
    return sql(_INPUTS, _pair_ctes((statement, first), (statement, second)) + [
        ("total", f"""
SELECT cik, period_ending, a.fiscal_year, a.fiscal_period, a.currency, a.val + b AS amount FROM pair WHERE {kept}"""),
        USD_RATES,
        _in_usd("total"),
        ("valued", "SELECT *, amount * factor AS value FROM in_usd WHERE factor IS NOT NULL"),
        BEST_TICKER,
    ], _named("valued", "fiscal_year, fiscal_period, currency", limit))


@query("top_sum", "M15 D5 F2 F3 D6 G1", _sum_oracle("income_statement", "total_revenue", "net_income"))
def top_sum(c):
    return rank.top_by_sum(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                           "income_statement", "total_revenue", "net_income", limit=25, as_of=AS_OF)


def _ratio_oracle(statement, num, den, limit=25, min_value=None, max_value=None, min_den=None, den_statement=None,
                  exclude_fin=True):
    low = "-Infinity" if min_value is None else float(min_value)
    high = "Infinity" if max_value is None else float(max_value)
    return sql(["fx_std", "fx_companies", "fx_primary_tickers"], _pair_ctes(
        (statement, num), (den_statement or statement, den),
        "company_type NOT IN ('financial', 'insurance')" if exclude_fin else "TRUE",
        "b > 0" if min_den is None else f"b > 0 AND b >= {float(min_den)}") + [
        ("percent", "SELECT cik, period_ending, a.fiscal_year, a.fiscal_period, round(a.val / b * 100, 2) + 0.0 AS value FROM pair"),
        ("bounded", f"SELECT * FROM percent WHERE value BETWEEN '{low}'::DOUBLE AND '{high}'::DOUBLE"),
        BEST_TICKER,
    ], _named("bounded", "fiscal_year, fiscal_period", limit))


@query("top_ratio", "M16 C6 F2 F3 I16 G1",
       _ratio_oracle("income_statement", "net_income", "total_revenue", min_value=0.0, max_value=99.99,
                     min_den=100000.0))
def top_ratio(c):
    return rank.top_by_ratio(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], "income_statement",
                             "net_income", "total_revenue", limit=25, min_value=0.0, max_value=99.99,
                             min_denominator=100000.0, as_of=AS_OF)


@query("top_ratio_cross_statement", "M16 D5 (two statements)",
       _ratio_oracle("income_statement", "net_income", "total_assets", min_value=0.0, max_value=500.0,
                     min_den=1000000.0, den_statement="balance_sheet", exclude_fin=False))
def top_ratio_cross_statement(c):
    return rank.top_by_ratio(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], "income_statement",
                             "net_income", "total_assets", limit=25, min_value=0.0, max_value=500.0,
                             min_denominator=1000000.0, denominator_statement="balance_sheet",
                             exclude_financial=False, as_of=AS_OF)


def _all_metrics_oracle(limit=25):
    return sql(_INPUTS, _metric_ctes(dims.catalogue_values_sql()), f"""
SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, cik) AS INTEGER) AS rank
FROM ranked QUALIFY rank <= {limit}""")


@query("top_all_metrics", "M17 (catalogue, one scan)", _all_metrics_oracle())
def top_all_metrics(c):
    cat = dims.catalogue_df(c.spark)
    return rank.top_all_metrics(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"], cat,
                                limit=25, as_of=AS_OF)


@query("top_all_pairs", "M17 F2 F3 D5 I16 (catalogue sums and ratios, one scan)",
       sql(["fx_catalogue", *_INPUTS[1:]], [
    ("specs", dims.pairs_values_sql()),
    ("recent", f"SELECT * FROM fx_catalogue WHERE frequency = 'annual' AND val IS NOT NULL AND period_ending >= {R}"),
    ("firsts", """
SELECT metric, cik, period_ending, arg_max(s, (fiscal_year, fiscal_period, val)) AS a
FROM recent s JOIN specs k ON s.statement = statement_a AND s.tag = tag_a
WHERE if(kind = 'ratio' AND exclude_financial, company_type NOT IN ('financial', 'insurance'), TRUE) GROUP BY metric, cik, period_ending"""),
    ("seconds", """
SELECT metric, cik, period_ending, arg_max(val, (fiscal_year, fiscal_period, val)) AS b
FROM recent s JOIN specs k ON s.statement = statement_b AND s.tag = tag_b GROUP BY metric, cik, period_ending"""),
    ("newest", """
SELECT * FROM firsts JOIN seconds USING (metric, cik, period_ending) JOIN specs USING (metric)
WHERE kind = 'sum' OR (b > 0 AND b >= coalesce(min_denominator, b))
QUALIFY row_number() OVER (PARTITION BY metric, cik ORDER BY period_ending DESC) = 1"""),
    ("kept", """
SELECT *, a.currency AS currency FROM newest
WHERE kind = 'ratio' OR NOT exclude_financial OR a.company_type NOT IN ('financial', 'insurance')"""),
    USD_RATES,
    _in_usd("kept"),
    ("valued", """
SELECT * EXCLUDE (currency), if(kind = 'sum', currency, NULL) AS currency,
       if(kind = 'sum', (a.val + b) * factor, round(a.val / b * 100, 2) + 0.0) AS value FROM in_usd"""),
    BEST_TICKER,
], """
SELECT metric, cik, ticker, coalesce(entity_name, '') AS name, strftime(period_ending, '%Y-%m-%d') AS period_ending, a.fiscal_year AS fiscal_year,
       a.fiscal_period AS fiscal_period, currency, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, cik) AS INTEGER) AS rank
FROM valued JOIN fx_companies USING (cik) JOIN best_ticker USING (cik)
WHERE value >= coalesce(min_value, value) AND value <= coalesce(max_value, value) QUALIFY rank <= 25"""))
def top_all_pairs(c):
    return rank.top_all_pairs(c["fx_catalogue"], c["fx_companies"], c["fx_primary_tickers"], c["fx_calendar"],
                              dims.pairs_df(c.spark), limit=25, as_of=AS_OF)


@query("asof_rate", "D6 D7 7.3", sql(["fx_std", "fx_rates"], [
    ("pairs", "SELECT DISTINCT currency, period_ending FROM fx_std WHERE currency <> 'USD'"),
    USD_RATES,
    _in_usd("pairs"),
], "SELECT currency, period_ending, factor AS rate FROM in_usd"))
def asof_rate(c):
    std = c["fx_std"]
    pairs = std.where(F.col("currency").isNotNull() & (F.col("currency") != "USD"))
    return asof_pairs(pairs, c["fx_rates"]).select("currency", "period_ending", "rate")


@query("latest_per_company", "F1 C1 C2", sql(["fx_std"], [], f"""
SELECT DISTINCT ON (cik) cik, period_ending, fiscal_year, fiscal_period, currency, val, company_type FROM fx_std
WHERE (statement, tag, frequency) = ('income_statement', 'total_revenue', 'annual') AND val IS NOT NULL
  AND period_ending >= {R}
ORDER BY cik, period_ending DESC, fiscal_year DESC, fiscal_period DESC, val DESC"""))
def latest_per_company(c):
    s = rank.statement_filter(c["fx_std"], "income_statement", "total_revenue", "annual", AS_OF)
    return latest_by(s, ["cik"], rank.LATEST_ORDER,
                     cols=["cik", "period_ending", "fiscal_year", "fiscal_period", "currency", "val", "company_type"])


@query("best_ticker", "F4", sql(["fx_primary_tickers"], [BEST_TICKER], "SELECT cik, ticker FROM best_ticker"))
def best_ticker_q(c):
    return rank.best_ticker(c["fx_primary_tickers"])


# Events by user; a third of them by one user. Quotes are purchases, the last one of a day counts.
@query("asof_keyed", "D6 7.3 (as-of join by any key, one key with a third of the rows)", sql([], [
    ("e", "SELECT event_id, if(event_id % 3 = 0, 0, user_id) AS k, CAST(ts AS DATE) AS d, event_type, CAST(value AS DOUBLE) AS v FROM events"),
    ("q", "SELECT k, d AS quote_day, max((event_id, v)) AS q FROM e WHERE event_type = 'purchase' GROUP BY k, d")], """
SELECT e.event_id, e.k, e.d, quote_day, q[1] AS quote_id, q[2] AS quote FROM e ASOF LEFT JOIN q ON e.k = q.k AND e.d >= q.quote_day
WHERE event_type <> 'purchase'"""))
def asof_keyed(c):
    e = c["events"].select("event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k"), F.to_date("ts").alias("d"), "event_type",
                           F.col("value").cast("double").alias("v"))
    quotes = e.where("event_type = 'purchase'").select("k", F.col("d").alias("quote_day"), F.col("event_id").alias("quote_id"), F.col("v").alias("quote"))
    return asof.asof_join(e.where("event_type <> 'purchase'").select("event_id", "k", "d"), quotes, ["k"], "d", "quote_day", ["quote_id", "quote"])
