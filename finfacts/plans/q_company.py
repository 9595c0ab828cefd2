"""Company lists, symbol resolution, search and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.operators import profile as pf
from finfacts.operators import resolve as rs
from finfacts.operators.sets import location_dim
from finfacts.plans.q_ingest import _PROCESSED_CTES, processed
from finfacts.plans.registry import query, sql

_P = ["fx_doc", "fx_companies", "fx_tickers", "fx_primary_tickers"]


@query("companies_with_financials", "M3 D4 C9 E1", sql(_P, _PROCESSED_CTES, """
SELECT c.cik, min(t.ticker) AS ticker, min(c.entity_name) AS name
FROM fx_companies c JOIN fx_tickers t ON t.cik = c.cik JOIN processed p ON p.cik = c.cik
WHERE p.has_balance AND p.has_income AND p.has_cash_flow GROUP BY c.cik"""))
def companies_with_financials(c):
    return rs.companies_with_financials(c["fx_companies"], c["fx_tickers"], processed(c))


@query("company_choices", "M4 D4 G2", sql(_P, _PROCESSED_CTES, """
SELECT c.entity_name AS label, pt.ticker AS value, pt.cik, pt.ticker || ' | ' || pt.cik AS description, pt.rank
FROM fx_primary_tickers pt JOIN fx_companies c ON c.cik = pt.cik JOIN processed p ON p.cik = pt.cik
WHERE p.has_balance AND p.has_income AND p.has_cash_flow ORDER BY pt.rank NULLS LAST, pt.ticker, pt.cik"""))
def company_choices(c):
    return rs.company_choices(c["fx_primary_tickers"], c["fx_companies"], processed(c))


_SYMBOLS_SQL = """
SELECT lower(ticker) AS symbol FROM fx_tickers
UNION SELECT ticker FROM fx_tickers
UNION SELECT symbol FROM fx_funds
UNION SELECT ticker FROM fx_multi_cik"""


def _symbols(c):
    t = c["fx_tickers"]
    return (t.select(F.lower("ticker").alias("symbol")).union(t.select(F.col("ticker").alias("symbol")))
             .union(c["fx_funds"].select("symbol")).union(c["fx_multi_cik"].select(F.col("ticker").alias("symbol"))))


@query("resolve_symbols", "M5 I2 D10", sql(["fx_tickers", "fx_funds", "fx_multi_cik"], [
    ("symbols", _SYMBOLS_SQL),
    ("s", "SELECT DISTINCT symbol, translate(upper(symbol), '.', '-') AS sym FROM symbols"),
    ("m", """SELECT ticker AS sym, string_agg(cik, ',' ORDER BY priority, cik) AS ciks FROM fx_multi_cik GROUP BY ticker"""),
    ("t", "SELECT ticker AS sym, min(cik) AS cik FROM fx_tickers GROUP BY ticker"),
    ("f", "SELECT symbol AS sym, min(cik) AS cik FROM fx_funds GROUP BY symbol"),
], """
SELECT s.symbol, CASE WHEN m.ciks IS NOT NULL THEN 1 WHEN t.cik IS NOT NULL THEN 2 WHEN f.cik IS NOT NULL THEN 3 END AS tier,
       coalesce(m.ciks, t.cik, f.cik) AS ciks
FROM s LEFT JOIN m ON m.sym = s.sym LEFT JOIN t ON t.sym = s.sym LEFT JOIN f ON f.sym = s.sym"""))
def resolve_symbols(c):
    return rs.resolve_symbols(_symbols(c), c["fx_multi_cik"], c["fx_tickers"], c["fx_funds"])


@query("resolve_ciks", "M6", sql(["fx_companies", "fx_tickers"], [], """
SELECT c.cik, coalesce(min(t.ticker), '') AS ticker
FROM (SELECT DISTINCT cik FROM fx_companies) c LEFT JOIN fx_tickers t ON t.cik = c.cik GROUP BY c.cik"""))
def resolve_ciks(c):
    return rs.resolve_ciks(c["fx_companies"], c["fx_tickers"])


SEARCH_KEYWORD = "#00000"


@query("search_entities", "M7 C8 G5", sql(["fx_companies"], [], f"""
SELECT cik, entity_name FROM fx_companies WHERE entity_name LIKE '{rs.like_pattern(SEARCH_KEYWORD)}' ESCAPE '\\' ORDER BY entity_name, cik"""))
def search_entities(c):
    return rs.search_entities(c["fx_companies"], SEARCH_KEYWORD)


# Keywords from the names themselves: their endings, single and double letters, wildcards, signs that LIKE knows, nothing.
_KEYWORDS_SQL = """
SELECT DISTINCT keyword FROM (
  SELECT substring(entity_name, 12, 7) AS keyword FROM fx_cust WHERE c_custkey % 40 = 1
  UNION ALL SELECT concat('_', substring(entity_name, length(entity_name) - 2, 3)) FROM fx_cust WHERE c_custkey % 50 = 2
  UNION ALL SELECT concat(substring(entity_name, 1, 2), '_', substring(entity_name, 4, 6)) FROM fx_cust WHERE c_custkey % 70 = 3
  UNION ALL SELECT substring(entity_name, 17, 2) FROM fx_cust WHERE c_custkey % 90 = 4
  UNION ALL SELECT substring(entity_name, 18, 1) FROM fx_cust WHERE c_custkey % 90 = 5
  UNION ALL SELECT concat('0', '%', substring(entity_name, 18, 1)) FROM fx_cust WHERE c_custkey % 90 = 6
  UNION ALL SELECT '__________________' FROM fx_cust WHERE c_custkey = 1
  UNION ALL SELECT '' FROM fx_cust WHERE c_custkey = 1
) k"""


@query("search_batch", "M7 C8 G5 (a table of keywords; trigram postings, LIKE verified)", sql(["fx_companies", "fx_cust"], [
    ("keywords", _KEYWORDS_SQL)], r"""
SELECT keyword, cik, entity_name FROM keywords JOIN fx_companies
  ON entity_name LIKE '%' || replace(replace(keyword, '\', '\\'), '%', '\%') || '%' ESCAPE '\'
QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY entity_name, cik) <= 50"""))
def search_batch(c):
    k = c["fx_cust"]
    name = F.col("entity_name")
    found = lambda mod, rest, kw: k.where(F.col("c_custkey") % mod == rest).select(kw.alias("keyword"))
    keywords = found(40, 1, F.substring(name, 12, 7))
    for mod, rest, kw in ((50, 2, F.concat(F.lit("_"), F.expr("substring(entity_name, length(entity_name) - 2, 3)"))),
                          (70, 3, F.concat(F.substring(name, 1, 2), F.lit("_"), F.substring(name, 4, 6))), (90, 4, F.substring(name, 17, 2)),
                          (90, 5, F.substring(name, 18, 1)), (90, 6, F.concat(F.lit("0%"), F.substring(name, 18, 1)))):
        keywords = keywords.union(found(mod, rest, kw))
    for kw in ("_" * 18, ""):
        keywords = keywords.union(k.where("c_custkey = 1").select(F.lit(kw)))
    return rs.search_keywords(c["fx_companies"], keywords, "keyword", limit=50)


# Ciks reached over shared tickers, step by step until nothing new comes.
_CANON_CTES = [
    ("reach(cik, other)", """
SELECT DISTINCT cik, cik FROM fx_multi_cik
UNION
SELECT r.cik, n.cik FROM reach r JOIN fx_multi_cik m ON m.cik = r.other JOIN fx_multi_cik n ON n.ticker = m.ticker"""),
    ("mc", "SELECT r.cik, arg_min(m.cik, (m.priority, m.cik)) AS pcik FROM reach r JOIN fx_multi_cik m ON m.cik = r.other GROUP BY r.cik"),
    ("allc", "SELECT cik FROM fx_companies UNION SELECT cik FROM fx_multi_cik"),
    ("canon", "SELECT a.cik, coalesce(mc.pcik, a.cik) AS primary_cik FROM allc a LEFT JOIN mc USING (cik)"),
]


@query("canonical_ciks", "L12 7.4 (cik -> primary cik, over chains of tickers)", sql(["fx_companies", "fx_multi_cik"], _CANON_CTES,
                                                           "SELECT cik, primary_cik FROM canon"))
def canonical_ciks(c):
    return pf.canonical_ciks(c["fx_companies"], c["fx_multi_cik"])


def _dei(c):
    s = c["fx_sic"]
    code = s.select("cik", F.lit("EntitySicCode").alias("tag"), "val", F.lit(None).cast("string").alias("val_text"),
                    F.col("end_date").alias("end"), "filed", "id")
    descr = s.where(F.col("val_text").isNotNull()).select(
        "cik", F.lit("EntitySicDescription").alias("tag"), F.lit(None).cast("double").alias("val"), "val_text",
        F.col("end_date").alias("end"), "filed", "id")
    # State of incorporation and fiscal-year end: invented values, by the fact's number.
    attribute = s.select("cik", F.explode(F.array(
        F.struct(F.lit("EntityStateOfIncorporation").alias("tag"), F.when(F.col("id") % 10 == 0, "DE").when(F.col("id") % 10 == 2, "A6").when(F.col("id") % 10 == 4, "ZZ").alias("val_text")),
        F.struct(F.lit("EntityFiscalYearEnd").alias("tag"), F.when(F.col("id") % 4 == 0, "1231").when(F.col("id") % 4 == 2, "0630").alias("val_text")))).alias("a"),
        "end_date", "filed", "id")
    attribute = attribute.select("cik", "a.tag", F.lit(None).cast("double").alias("val"), "a.val_text", F.col("end_date").alias("end"), "filed", "id")
    return code.unionByName(descr).unionByName(attribute.where("val_text is not null"))


@query("company_profiles", "M8 F5 E2 G3 I5 L12", sql(["fx_companies", "fx_multi_cik", "fx_tickers", "fx_sic", "fx_std"],
                                                    _CANON_CTES + [
    ("grp", "SELECT cik, primary_cik FROM canon"),
    ("related", """
SELECT primary_cik, coalesce(string_agg(CASE WHEN cik <> primary_cik THEN cik END, ',' ORDER BY cik), '') AS related_ciks
FROM grp GROUP BY primary_cik"""),
    ("tk", """
SELECT g.primary_cik, t.ticker, t.is_primary,
       row_number() OVER (PARTITION BY g.primary_cik ORDER BY t.is_primary DESC, length(t.ticker), t.ticker) AS o
FROM fx_tickers t JOIN grp g ON g.cik = t.cik"""),
    ("ptk", """
SELECT primary_cik, coalesce(min(CASE WHEN is_primary THEN o END), 1) AS po FROM tk GROUP BY primary_cik"""),
    ("tks", """
SELECT tk.primary_cik, max(CASE WHEN tk.o = p.po THEN tk.ticker END) AS primary_ticker,
       coalesce(string_agg(CASE WHEN tk.o <> p.po THEN tk.ticker END, ',' ORDER BY tk.o), '') AS secondary_tickers
FROM tk JOIN ptk p USING (primary_cik) GROUP BY tk.primary_cik"""),
    ("code", """
SELECT primary_cik, val FROM (
  SELECT g.primary_cik, s.val, row_number() OVER (PARTITION BY g.primary_cik ORDER BY s.end_date DESC, s.filed DESC, s.id DESC) AS rn
  FROM fx_sic s JOIN grp g ON g.cik = s.cik) z WHERE rn = 1"""),
    ("descr", """
SELECT primary_cik, val_text FROM (
  SELECT g.primary_cik, s.val_text, row_number() OVER (PARTITION BY g.primary_cik ORDER BY s.end_date DESC, s.filed DESC, s.id DESC) AS rn
  FROM fx_sic s JOIN grp g ON g.cik = s.cik WHERE s.val_text IS NOT NULL) z WHERE rn = 1"""),
    ("attributes", """
SELECT g.primary_cik, arg_max(CASE id % 10 WHEN 0 THEN 'DE' WHEN 2 THEN 'A6' WHEN 4 THEN 'ZZ' END, (s.end_date, s.filed, s.id)) AS state,
       arg_max(CASE id % 4 WHEN 0 THEN '1231' WHEN 2 THEN '0630' END, (s.end_date, s.filed, s.id)) AS year_end
FROM fx_sic s JOIN grp g ON g.cik = s.cik GROUP BY ALL"""),
    ("periods", """
SELECT g.primary_cik, min(s.period_ending) AS first_period, max(s.period_ending) AS latest_period
FROM fx_std s JOIN grp g ON g.cik = s.cik GROUP BY g.primary_cik"""),
], """
SELECT b.primary_cik AS cik, n.entity_name AS name, tks.primary_ticker, tks.secondary_tickers, r.related_ciks,
       CASE WHEN b.primary_cik LIKE '%1' THEN 'NYSE,Nasdaq' END AS exchanges, a.state AS state_of_incorporation,
       CASE a.state WHEN 'DE' THEN 'Delaware' WHEN 'A6' THEN 'Ontario, Canada' END AS state_of_incorporation_name,
       lpad(CAST(CAST(floor(code.val) AS INTEGER) AS VARCHAR), 4, '0') AS sic, descr.val_text AS sic_name,
       a.year_end AS fiscal_year_end, periods.first_period, periods.latest_period
FROM (SELECT DISTINCT primary_cik FROM grp) b
LEFT JOIN fx_companies n ON n.cik = b.primary_cik
LEFT JOIN tks ON tks.primary_cik = b.primary_cik
LEFT JOIN related r ON r.primary_cik = b.primary_cik
LEFT JOIN code ON code.primary_cik = b.primary_cik
LEFT JOIN attributes a ON a.primary_cik = b.primary_cik
LEFT JOIN descr ON descr.primary_cik = b.primary_cik
LEFT JOIN periods ON periods.primary_cik = b.primary_cik"""))
def company_profiles(c):
    canon = c["cik_canonical"]
    filed = canon.where(F.col("cik").endswith("1")).select("cik", F.array(F.lit("NYSE"), F.lit("Nasdaq"), F.lit("NYSE")).alias("exchanges"))
    return pf.company_profiles(canon, c["fx_companies"], c["fx_tickers"], _dei(c), c["fx_std"],
                               submissions=filed, locations=location_dim(c.spark))
