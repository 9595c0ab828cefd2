"""Fixture tables derived by SQL from the driver's TPC-H-style tables.

The reference ships no filing data, so the analytical operators are exercised on
tables *shaped* like its store (standardized statements, tickers, rates, SIC
facts, company-facts JSON, content hashes), derived from ``customer``,
``orders``, ``lineitem`` ... (see FIXTURES.md). The SQL text is the same for
Spark and DuckDB: Spark registers each body as a view; the DuckDB oracle gets
them as a ``WITH`` prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.session import scratch_path

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

# (name, dependencies, body). Order is a valid build order.
FIXTURES: list[tuple[str, tuple[str, ...], str]] = [
    ("fx_ccy", (), """
SELECT * FROM (VALUES (0,'ZAR'), (1,'USD'), (2,'JPY'), (3,'EUR'), (4,'XXX')) AS t(regionkey, currency)"""),
    ("fx_cust", ("fx_ccy",), """
SELECT c.c_custkey, lpad(CAST(c.c_custkey AS STRING), 10, '0') AS cik, c.c_name AS entity_name,
       CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE k.currency END AS currency,
       CAST(c.c_acctbal AS DECIMAL(18,2)) AS bal,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'financial' WHEN 'MACHINERY' THEN 'insurance' ELSE 'industrial' END AS company_type
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN fx_ccy k ON k.regionkey = n.n_regionkey"""),
    ("fx_companies", ("fx_cust",), """
SELECT cik, entity_name FROM fx_cust WHERE c_custkey % 17 <> 0"""),
    ("fx_primary_tickers", ("fx_cust",), """
SELECT cik, concat('T', CAST(c_custkey AS STRING)) AS ticker,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS INT) END AS rank
FROM fx_cust WHERE c_custkey % 11 <> 3
UNION ALL
SELECT cik, concat('T', CAST(c_custkey AS STRING), '-B'), CAST(c_custkey % 7 AS INT) FROM fx_cust WHERE c_custkey % 5 = 0
UNION ALL
SELECT cik, CASE c_custkey WHEN 5 THEN 'NKE' ELSE 'DIS' END, CAST(c_custkey AS INT) FROM fx_cust WHERE c_custkey IN (5, 9)"""),
    ("fx_tickers", ("fx_primary_tickers",), """
SELECT cik, ticker, ticker NOT LIKE '%-B' AS is_primary, rank FROM fx_primary_tickers"""),
    ("fx_multi_cik", ("fx_cust",), """
SELECT concat('T', CAST(c_custkey AS STRING)) AS ticker, cik, 1 AS priority FROM fx_cust WHERE c_custkey % 50 IN (7, 20, 21, 22, 24)
UNION ALL
SELECT concat('T', CAST(c_custkey AS STRING)), lpad(CAST(c_custkey + 1 AS STRING), 10, '0'), CASE WHEN c_custkey % 50 = 21 THEN 2 ELSE 0 END
FROM fx_cust WHERE c_custkey % 50 IN (7, 20, 21, 22, 24)
UNION ALL
SELECT concat('T', CAST(c_custkey AS STRING)), lpad(CAST(c_custkey + 50 AS STRING), 10, '0'), 3 FROM fx_cust WHERE c_custkey % 100 = 24"""),
    ("fx_funds", (), """
SELECT lpad(CAST(900000 + s_suppkey AS STRING), 10, '0') AS cik, concat('S', CAST(s_suppkey AS STRING)) AS series_id,
       concat('C', CAST(s_suppkey AS STRING)) AS class_id, concat('F', CAST(s_suppkey AS STRING)) AS symbol FROM supplier"""),
    ("fx_line", ("fx_cust",), """
SELECT u.cik, u.currency, u.company_type, u.bal, CAST(o.o_orderdate AS DATE) AS d,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l.l_discount AS DECIMAL(4,2)) AS disc
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN fx_cust u ON u.c_custkey = o.o_custkey"""),
    ("fx_year", ("fx_line",), """
SELECT cik, currency, company_type, bal, CAST(year(d) AS INT) AS fiscal_year, max(d) AS period_ending,
       sum(price) AS rev, sum(price * (1 - disc)) AS cost, sum(price * (disc - CAST(0.05 AS DECIMAL(4,2)))) AS ni
FROM fx_line GROUP BY cik, currency, company_type, bal, CAST(year(d) AS INT)"""),
    ("fx_quarter", ("fx_line",), """
SELECT cik, currency, company_type, CAST(year(d) AS INT) AS fiscal_year, concat('Q', CAST(quarter(d) AS STRING)) AS fiscal_period,
       max(d) AS period_ending, sum(price) AS rev, sum(price * (disc - CAST(0.05 AS DECIMAL(4,2)))) AS ni
FROM fx_line GROUP BY cik, currency, company_type, CAST(year(d) AS INT), concat('Q', CAST(quarter(d) AS STRING))"""),
    ("fx_std", ("fx_year", "fx_quarter"), """
SELECT cik, 'income_statement' AS statement, period_ending, fiscal_year, 'FY' AS fiscal_period, 'annual' AS frequency,
       'total_revenue' AS tag, CAST(rev AS DOUBLE) AS val, currency, company_type FROM fx_year
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'total_cost_of_revenue', CAST(cost AS DOUBLE), currency, company_type FROM fx_year WHERE fiscal_year % 3 <> 0
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'net_income', CASE WHEN fiscal_year % 5 = 0 THEN NULL ELSE CAST(ni AS DOUBLE) END, currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'total_assets', CAST(bal * 1000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'goodwill', CASE WHEN cik LIKE '%3' THEN CAST(bal * 10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, currency, company_type FROM fx_year
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, fiscal_period, 'quarterly', 'total_revenue', CAST(rev AS DOUBLE), currency, company_type FROM fx_quarter
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, fiscal_period, 'quarterly', 'net_income', CAST(ni AS DOUBLE), currency, company_type FROM fx_quarter WHERE fiscal_period <> 'Q2'
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, fiscal_period, 'quarterly', 'total_assets', CAST(rev * 10 AS DOUBLE), currency, company_type FROM fx_quarter"""),
    # Annual values for every item of the catalogue's sums and ratios, large enough for their smallest denominators.
    ("fx_catalogue", ("fx_year",), """
SELECT cik, 'income_statement' AS statement, period_ending, fiscal_year, 'FY' AS fiscal_period, 'annual' AS frequency, 'total_revenue' AS tag, CAST(rev * 10000 AS DOUBLE) AS val, currency, company_type FROM fx_year
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'total_gross_profit', CAST((rev - cost) * 10000 AS DOUBLE), currency, company_type FROM fx_year WHERE fiscal_year % 3 <> 0
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'total_operating_income', CAST(ni * 20000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'net_income', CAST(ni * 10000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'income_statement', period_ending, fiscal_year, 'FY', 'annual', 'net_interest_income', CAST(cost * 1000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'total_assets', CAST(rev * 20000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'total_equity', CAST(rev * 5000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'long_term_debt', CAST(rev * 3000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'balance_sheet', period_ending, fiscal_year, 'FY', 'annual', 'current_portion_of_long_term_debt', CAST(cost * 1000 AS DOUBLE), currency, company_type FROM fx_year WHERE fiscal_year % 3 <> 0
UNION ALL SELECT cik, 'cash_flow', period_ending, fiscal_year, 'FY', 'annual', 'net_cash_from_operating_activities', CAST(cost * 9000 AS DOUBLE), currency, company_type FROM fx_year
UNION ALL SELECT cik, 'cash_flow', period_ending, fiscal_year, 'FY', 'annual', 'purchase_of_plant_property_and_equipment', CAST(rev * -1000 AS DOUBLE), currency, company_type FROM fx_year"""),
    ("fx_source", ("fx_std",), """
SELECT cik, statement, tag, period_ending,
       CASE WHEN cik LIKE '%7' THEN concat('us-gaap:V', CAST(fiscal_year AS STRING)) WHEN fiscal_year < 1998 THEN 'us-gaap:A' WHEN fiscal_year < 2000 THEN 'derived: net_income (Q4)' ELSE 'us-gaap:B (fallback)' END AS source
FROM fx_std WHERE frequency = 'annual'"""),
    # Same rows as FIXTURES.md's fx_rates; the three quoted currencies are a UNION ALL
    # instead of a non-equi join to the currency list, so no plan has a nested loop.
    ("fx_rates", (), """
SELECT rate_date, from_currency, 'USD' AS to_currency,
       CASE from_currency WHEN 'JPY' THEN CAST(0.008 AS DOUBLE) + (day(rate_date) % 5) / CAST(1000 AS DOUBLE)
                          WHEN 'EUR' THEN CAST(1 AS DOUBLE) + month(rate_date) / CAST(64 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) END AS rate
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS rate_date, 'JPY' AS from_currency FROM orders
      UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'EUR' FROM orders
      UNION ALL SELECT DISTINCT CAST(o_orderdate AS DATE), 'ZAR' FROM orders) r
WHERE day(rate_date) % 7 NOT IN (0, 6) AND NOT (from_currency = 'ZAR' AND rate_date < DATE '2000-06-01')"""),
    ("fx_code", (), """
SELECT * FROM (VALUES (0,7372),(1,2834),(2,2899),(3,1390),(4,9995),(5,100),(6,6021),(7,3674),(8,4911),(9,5812)) AS t(slot, code)"""),
    ("fx_sic", ("fx_cust", "fx_code"), """
SELECT u.c_custkey * 2 AS id, u.cik, CAST(k.code AS DOUBLE) AS val,
       CASE WHEN u.c_custkey % 3 = 0 THEN NULL ELSE concat('Descr ', CAST(k.code AS STRING)) END AS val_text,
       DATE '1999-12-31' AS end_date, DATE '2000-02-01' AS filed FROM fx_cust u JOIN fx_code k ON k.slot = u.c_custkey % 10
UNION ALL
SELECT u.c_custkey * 2 + 1, u.cik, CAST(k.code AS DOUBLE), concat('Descr ', CAST(k.code AS STRING)),
       DATE '1999-12-31', DATE '2000-02-01' FROM fx_cust u JOIN fx_code k ON k.slot = (u.c_custkey + 1) % 10 WHERE u.c_custkey % 4 = 0"""),
    ("fx_doc", (), """
SELECT event_id, concat('{"cik":', CAST(user_id AS STRING), ',"entityName":"U', CAST(user_id AS STRING),
       '","facts":{"us-gaap":{"', event_type, '":{"label":"', event_type, CASE WHEN event_id % 3 = 0 THEN ' (old)' ELSE '' END,
       '","description":"About ', event_type, '","units":{"USD":[{"end":"',
       substring(CAST(CAST(ts AS DATE) AS STRING), 1, 10), '","val":', CAST(CAST(value AS DECIMAL(10,2)) AS STRING),
       ',"fy":', CASE WHEN event_id % 7 = 0 THEN '"2024"' WHEN event_id % 7 = 1 THEN '"bad"' ELSE '2024' END,
       CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(',"accn":"0001-24-', CAST(event_id % 40 AS STRING), '"') END,
       ',"fp":"', CASE WHEN event_id % 20 < 2 THEN 'FY' WHEN event_id % 20 < 4 THEN 'Q1' WHEN event_id % 20 < 6 THEN 'Q2'
                       WHEN event_id % 20 < 8 THEN 'Q3' WHEN event_id % 20 = 8 THEN 'Q4' ELSE '' END, '"',
       CASE WHEN event_type IN ('purchase', 'click') THEN concat(',"start":"',
            CASE WHEN event_id % 20 < 2 THEN substring(CAST(CAST(CAST(ts AS DATE) - INTERVAL '364' DAY AS DATE) AS STRING), 1, 10)
                 WHEN event_id % 20 < 9 THEN substring(CAST(CAST(CAST(ts AS DATE) - INTERVAL '90' DAY AS DATE) AS STRING), 1, 10)
                 ELSE substring(CAST(CAST(CAST(ts AS DATE) - INTERVAL '180' DAY AS DATE) AS STRING), 1, 10) END, '"') ELSE '' END,
       ',"form":"', CASE WHEN event_id % 20 < 2 THEN '10-K' ELSE '10-Q' END, '","filed":"',
       substring(CAST(CAST(CAST(ts AS DATE) + INTERVAL '30' DAY AS DATE) AS STRING), 1, 10),
       CASE event_id % 31 WHEN 5 THEN 'T10:00:00' WHEN 6 THEN ' 10:00' WHEN 7 THEN 'x' ELSE '' END, '"',
       CASE WHEN event_id % 9 = 0 THEN ',"frame":"CY2023"' WHEN event_id % 9 = 1 THEN ',"frame":""' ELSE '' END, '}]}}}}}') AS payload
FROM events"""),
    # The fiscal quarter of every order day, for years that end in December (kind 0), January (1) or June (2), or have 52
    # or 53 weeks (3): six of those make 2,191 days, the last has 371. DISTINCT keeps the steps apart.
    ("fx_fiscal_day", (), """
SELECT DISTINCT kind, d, fy_start, slot,
       CASE WHEN kind < 3 THEN make_date(fy0 + CASE WHEN m0 + 3 * (slot - 1) > 12 THEN 1 ELSE 0 END, (m0 + 3 * (slot - 1) - 1) % 12 + 1, 1)
            ELSE fy_start + CAST(91 * (slot - 1) AS INT) END AS q_start,
       CASE WHEN kind < 3 THEN last_day(make_date(fy0 + CASE WHEN m0 + 3 * slot - 1 > 12 THEN 1 ELSE 0 END, (m0 + 3 * slot - 2) % 12 + 1, 1))
            WHEN slot < 4 THEN fy_start + CAST(91 * slot - 1 AS INT) ELSE fy_start + CAST(len - 1 AS INT) END AS q_end,
       CASE WHEN kind < 3 THEN last_day(make_date(fy0 + CASE WHEN m0 = 1 THEN 0 ELSE 1 END, (m0 + 10) % 12 + 1, 1))
            ELSE fy_start + CAST(len - 1 AS INT) END AS fy_end
FROM (
  SELECT DISTINCT kind, d, m0, fy0, CASE WHEN yr = 5 THEN 371 ELSE 364 END AS len,
         CASE WHEN kind < 3 THEN make_date(fy0, m0, 1) ELSE DATE '1992-01-05' + CAST(2191 * blk + 364 * yr AS INT) END AS fy_start,
         CASE WHEN kind < 3 THEN CAST(floor(((month(d) + 12 - m0) % 12) / 3) AS INT) + 1
              ELSE least(4, CAST(floor((days - 2191 * blk - 364 * yr) / 91) AS INT) + 1) END AS slot
  FROM (
    SELECT DISTINCT kind, d, m0, fy0, days, blk, least(5, CAST(floor((days - 2191 * blk) / 364) AS INT)) AS yr FROM (
      SELECT DISTINCT kind, d, m0, days, CAST(floor(days / 2191) AS INT) AS blk, CAST(year(d) - CASE WHEN month(d) < m0 THEN 1 ELSE 0 END AS INT) AS fy0 FROM (
        SELECT DISTINCT kind, m0, d, (year(d) - 1992) * 365 + CAST(floor((year(d) - 1989) / 4) AS INT) + dayofyear(d) - 5 AS days FROM (
          SELECT 0 AS kind, 1 AS m0, CAST(o_orderdate AS DATE) AS d FROM orders
          UNION ALL SELECT 1, 2, CAST(o_orderdate AS DATE) FROM orders
          UNION ALL SELECT 2, 7, CAST(o_orderdate AS DATE) FROM orders
          UNION ALL SELECT 3, 7, CAST(o_orderdate AS DATE) FROM orders) l0
      ) l1
    ) l2
  ) l3
) l4"""),
    ("fx_fiscal", ("fx_line", "fx_fiscal_day"), """
SELECT lpad(CAST(l.id AS STRING), 10, '0') AS cik, f.kind, f.fy_start, f.fy_end, f.slot, f.q_start, f.q_end, sum(l.price) AS rev
FROM (SELECT CAST(floor(CAST(cik AS INT) / 20) AS INT) AS id, CAST(floor(CAST(cik AS INT) / 20) AS INT) % 4 AS kind, d, price FROM fx_line) l
JOIN fx_fiscal_day f ON f.kind = l.kind AND f.d = l.d
GROUP BY l.id, f.kind, f.fy_start, f.fy_end, f.slot, f.q_start, f.q_end"""),
    # Years with sales in the first three quarters; without the fourth they have no annual facts.
    ("fx_fyear", ("fx_fiscal",), """
SELECT cik, kind, fy_start, fy_end, max(CASE WHEN slot = 1 THEN rev END) AS v1, max(CASE WHEN slot = 2 THEN rev END) AS v2,
       max(CASE WHEN slot = 3 THEN rev END) AS v3, max(CASE WHEN slot = 4 THEN rev END) AS v4,
       max(CASE WHEN slot = 1 THEN q_end END) AS e1, max(CASE WHEN slot = 2 THEN q_end END) AS e2, max(CASE WHEN slot = 3 THEN q_end END) AS e3,
       max(CASE WHEN slot = 2 THEN q_start END) AS s2, max(CASE WHEN slot = 3 THEN q_start END) AS s3
FROM fx_fiscal GROUP BY cik, kind, fy_start, fy_end HAVING count(CASE WHEN slot < 4 THEN 1 END) = 3"""),
    # Facts as filed: revenue by quarter and year, cash flow from the start of the year on (some without the half year).
    ("fx_ytd", ("fx_fyear",), """
SELECT y.cik, 'us-gaap' AS namespace, t.tag, 'USD' AS unit,
       CASE WHEN t.tag = 'Revenues' AND t.fp = 'Q2' THEN s2 WHEN t.tag = 'Revenues' AND t.fp = 'Q3' THEN s3 ELSE fy_start END AS start_date,
       CASE t.fp WHEN 'Q1' THEN e1 WHEN 'Q2' THEN e2 WHEN 'Q3' THEN e3 ELSE fy_end END AS end_date,
       CAST(CASE WHEN t.fp = 'Q1' THEN v1 WHEN t.fp = 'FY' THEN v1 + v2 + v3 + v4 WHEN t.tag = 'Revenues' AND t.fp = 'Q2' THEN v2
                 WHEN t.tag = 'Revenues' THEN v3 WHEN t.fp = 'Q2' THEN v1 + v2 ELSE v1 + v2 + v3 END AS DOUBLE) AS val,
       t.fp, CASE t.fp WHEN 'Q1' THEN e1 WHEN 'Q2' THEN e2 WHEN 'Q3' THEN e3 ELSE fy_end END + 30 AS filed
FROM fx_fyear y JOIN (VALUES """ + ", ".join(
        f"({kind}, '{tag}', '{fp}')" for kind in range(4) for tag in ("Revenues", "CashFromOperations") for fp in ("Q1", "Q2", "Q3", "FY")) + """) AS t(kind, tag, fp)
  ON t.kind = y.kind
WHERE (t.fp <> 'FY' OR v4 IS NOT NULL) AND NOT (t.tag = 'CashFromOperations' AND t.fp = 'Q2' AND CAST(y.cik AS INT) % 5 = 0)"""),
    # Statement schemas with tag lists five levels deep, quoted signs in tags and names, and items that are no tags.
    ("fx_schema", (), """
SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'income_statement' ELSE 'cash_flow' END AS statement,
       concat('{"title":"a ', chr(92), '"list', chr(92), '": [x]","sections":[{"rows":[{"xbrl_tags":[{"namespace":"us-gaap","tag":"A', CAST(s_suppkey AS STRING),
              '"},{"namespace":"dei","tag":"D"},7,null,{"namespace":"us-gaap"},{"namespace":"us-gaap","tag":5}],"children":{"deep":[[{"node":{"xbrl_tags":[',
              '{"namespace":"ifrs-full","tag":"B', chr(92), '"[', CAST(s_suppkey % 7 AS STRING), ']"},{"namespace":"us-gaap","tag":"C}]', CAST(s_suppkey % 5 AS STRING),
              '"}]}}]]}}]}],"xbrl_tags":"none"}') AS json FROM supplier"""),
    ("fx_hash_old", ("fx_cust",), """
SELECT cik, concat('h', CAST(c_custkey AS STRING)) AS h FROM fx_cust WHERE c_custkey % 10 <> 1"""),
    ("fx_hash_new", ("fx_cust",), """
SELECT cik, CASE WHEN c_custkey % 9 = 0 THEN concat('n', CAST(c_custkey AS STRING)) ELSE concat('h', CAST(c_custkey AS STRING)) END AS h FROM fx_cust"""),
]

def _std(cat: "FixtureCatalog") -> DataFrame:
    """The rows of ``fx_std`` in one pass: sales are summed by customer and quarter before customers are joined, years and
    quarters follow in one aggregation, and each gives its line items (the SQL above reads all sales once per branch)."""
    sales = cat.raw["orders"].join(cat.raw["lineitem"], F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_discount").cast("decimal(4,2)").alias("disc"))
    sales = sales.groupBy("o_custkey", F.year("d").alias("fiscal_year"), F.quarter("d").alias("q")).agg(
        F.max("d").alias("d"), F.sum("price").alias("rev"), F.sum(F.expr("price * (1 - disc)")).alias("cost"),
        F.sum(F.expr("price * (disc - CAST(0.05 AS DECIMAL(4,2)))")).alias("ni"))
    own = cat.tables["fx_cust"].join(sales, F.col("c_custkey") == F.col("o_custkey"))
    year, quarter = ["cik", "currency", "company_type", "bal", "fiscal_year"], ["cik", "currency", "company_type", "fiscal_year", "q"]
    keys = ["cik", "currency", "company_type", "bal", "fiscal_year", "q"]
    g = own.groupingSets([year, quarter], *keys).agg(
        (F.grouping("q") == 1).alias("annual"), F.max("d").alias("period_ending"), F.sum("rev").cast("decimal(28,2)").alias("rev"),
        F.sum("cost").cast("decimal(34,4)").alias("cost"), F.sum("ni").cast("decimal(34,4)").alias("ni"))

    def item(statement, tag, val, keep="true"):
        return F.expr(f"named_struct('statement', '{statement}', 'tag', '{tag}', 'val', CAST({val} AS DOUBLE), 'keep', {keep})")

    annual = F.array(item("income_statement", "total_revenue", "rev"), item("income_statement", "total_cost_of_revenue", "cost", "fiscal_year % 3 <> 0"),
                     item("income_statement", "net_income", "CASE WHEN fiscal_year % 5 = 0 THEN NULL ELSE ni END"), item("balance_sheet", "total_assets", "bal * 1000"),
                     item("balance_sheet", "goodwill", "CASE WHEN cik LIKE '%3' THEN CAST(bal * 10 AS DOUBLE) ELSE 0 END"))
    quarterly = F.array(item("income_statement", "total_revenue", "rev"), item("income_statement", "net_income", "ni", "q <> 2"),
                        item("balance_sheet", "total_assets", "rev * 10"))
    items = F.filter(F.when(F.col("annual"), annual).otherwise(quarterly), lambda x: x["keep"])
    return g.select("*", F.explode(items).alias("x")).select(
        "cik", "x.statement", "period_ending", "fiscal_year", F.when(F.col("annual"), "FY").otherwise(F.concat(F.lit("Q"), F.col("q").cast("string"))).alias("fiscal_period"),
        F.when(F.col("annual"), "annual").otherwise("quarterly").alias("frequency"), "x.tag", "x.val", "currency", "company_type")


#: Fixtures that Spark builds otherwise than by their SQL text, with the same rows.
_BUILT = {"fx_std": _std}
_BY_NAME = {name: (deps, body) for name, deps, body in FIXTURES}
_ORDER = [name for name, _, _ in FIXTURES]

# Fixed analysis date for every fixture query (the reference uses CURRENT_DATE,
# which makes results unrepeatable); orders in the driver data end near it.
AS_OF = "2001-08-01"
RECENT_FROM = "1999-08-01"  # AS_OF minus 24 months


def closure(names) -> list[str]:
    """Fixture names needed for ``names``, in build order."""
    need: set[str] = set()
    stack = [n for n in names if n in _BY_NAME]
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(_BY_NAME[n][0])
    return [n for n in _ORDER if n in need]


def oracle_prefix(names, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause for DuckDB holding the fixtures in ``names`` plus extra CTEs; one named with its columns is recursive."""
    parts = [f"{n} AS ({_BY_NAME[n][1]}\n)" for n in closure(names)]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    recursive = "RECURSIVE " if any(n.partition("(")[2] for n, _ in (extra or [])) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n"


class FixtureCatalog:
    """Builds (and optionally materialises) the fixture tables for one data folder."""

    _cache: dict[tuple[int, str], "FixtureCatalog"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.tables: dict[str, DataFrame] = {}
        self._stored: set[str] = set()
        self.raw: dict[str, DataFrame] = {}
        for t in RAW_TABLES:
            self.raw[t] = spark.read.parquet(f"{self.sf_dir}/{t}.parquet")
        self._build()

    def _build(self) -> None:
        # Temp views are resolved when ``spark.sql`` analyses the text, so each
        # DataFrame keeps the plan of *this* folder. The views are only scaffolding:
        # afterwards views the caller had under the same names are put back and the
        # rest are dropped, leaving the session's namespace as it was.
        names = list(self.raw) + _ORDER
        saved = {}
        for n in names:
            if self.spark.catalog.tableExists(n):
                try:
                    saved[n] = self.spark.table(n)
                except Exception:  # noqa: BLE001
                    pass
        try:
            for t, df in self.raw.items():
                df.createOrReplaceTempView(t)
            for name in _ORDER:
                df = _BUILT[name](self) if name in _BUILT else self.spark.sql(_BY_NAME[name][1])
                df.createOrReplaceTempView(name)
                self.tables[name] = df
        finally:
            for n in names:
                if n in saved:
                    saved[n].createOrReplaceTempView(n)
                else:
                    self.spark.catalog.dropTempView(n)

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str) -> "FixtureCatalog":
        key = (id(spark), sf_dir.rstrip("/"))
        cat = cls._cache.get(key)
        if cat is None:
            cat = cls(spark, sf_dir)
            cls._cache[key] = cat
        return cat

    # Tables Spark derives from the fixtures with the package's own operators, like
    # the reference's stored facts table (built once at ingest, read by queries).
    def _derived(self, name: str) -> DataFrame | None:
        if name == "facts":
            from finfacts.operators.facts import explode_company_facts
            return explode_company_facts(self.tables["fx_doc"], "payload", doc_id="event_id")
        if name == "cik_gics":   # stored classification, rebuilt by a job like the reference's
            from finfacts.operators.classify import classify
            from finfacts.plans import dims
            return classify(self.tables["fx_sic"], self.tables["fx_primary_tickers"], dims.sic_rules_df(self.spark),
                            dims.overrides_df(self.spark))
        if name == "cik_canonical":  # stored, rebuilt with the list of multi-registrant tickers
            from finfacts.operators.profile import canonical_ciks
            return canonical_ciks(self.tables["fx_companies"], self.tables["fx_multi_cik"])
        if name == "fx_calendar":  # stored as-of table, rebuilt with the rate table
            from finfacts.operators.asof import fx_calendar
            return fx_calendar(self.tables["fx_rates"])
        if name in ("xbrl_tags", "accessions"):  # stored dictionaries, grown load by load
            from finfacts.operators.dictionaries import dictionary_delta
            cols, attrs = (["namespace", "tag"], ["label", "description"]) if name == "xbrl_tags" else (["accn"], [])
            return dictionary_delta(None, self["facts"].where(F.col(cols[0]).isNotNull()), cols, attrs, "event_id")
        if name == "processed_ciks":
            from finfacts.operators.facts import processed_companies
            from finfacts.plans.q_ingest import statement_rules
            return processed_companies(self["facts"], statement_rules(self.spark))
        return None

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        d = self._derived(name)
        if d is not None:
            self.tables[name] = d
            return d
        return self.raw[name]

    def stored(self, name: str) -> DataFrame:
        """A table as files, written now if it isn't yet: for queries that read it many times over."""
        if name not in self._stored:
            self.materialize([name])
        return self.tables[name]

    def materialize(self, names=None) -> dict[str, int]:
        """Write fixture tables once to the shared checkpoint folder and read them back.

        ``fx_std`` (the big fact table) is laid out partitioned by statement and
        sorted by (tag, cik) so scans prune partitions and skip row groups.
        """
        counts: dict[str, int] = {}
        tag = self.sf_dir.strip("/").replace("/", "_")
        default = [n for n in _ORDER if n not in ("fx_line", "fx_year", "fx_quarter", "fx_fiscal_day", "fx_fiscal", "fx_fyear")] + ["facts", "cik_gics", "cik_canonical",
                                                                                          "processed_ciks", "fx_calendar", "xbrl_tags", "accessions"]
        for name in names or default:
            if name in self._stored:
                continue
            path = scratch_path(self.spark, f"fixtures/{tag}/{name}")
            df = self[name]
            if name == "fx_std":
                # REBALANCE keeps one statement per task and lets AQE split large ones.
                (df.hint("rebalance", "statement").sortWithinPartitions("statement", "tag", "cik")
                   .write.mode("overwrite").partitionBy("statement").parquet(path))
                back = self.spark.read.parquet(path).select(*df.columns)
            else:
                df.write.mode("overwrite").parquet(path)
                back = self.spark.read.parquet(path)
            self.tables[name] = back
            self._stored.add(name)
            counts[name] = -1
        return counts
