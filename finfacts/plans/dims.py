"""Small dimension tables: metric catalogue, SIC -> sector rules, ticker overrides,
location codes. Each is a literal of bounded size, shipped to executors by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from finfacts.operators.joins import literal_table

# ---------------------------------------------------------------------------
# The metric catalogue offered to users (label, spec). A spec is
# "statement|tag", "statement|a+b" (sum) or "statement|a/b" (ratio); two named
# ratios carry their own bounds below.
METRIC_CATALOGUE = [
    ("Revenue", "income_statement|total_revenue"),
    ("Net Income", "income_statement|net_income"),
    ("Operating Income", "income_statement|total_operating_income"),
    ("Gross Profit", "income_statement|total_gross_profit"),
    ("R&D Expense", "income_statement|rd_expense"),
    ("Total Assets", "balance_sheet|total_assets"),
    ("Return on Equity %", "cross|return_on_equity"),
    ("Long-Term Debt", "balance_sheet|long_term_debt"),
    ("Cash & Equivalents", "balance_sheet|cash_and_equivalents"),
    ("Total Debt", "balance_sheet|long_term_debt+current_portion_of_long_term_debt"),
    ("Operating Cash Flow", "cash_flow|net_cash_from_operating_activities"),
    ("Free Cash Flow", "cash_flow|net_cash_from_operating_activities+purchase_of_plant_property_and_equipment"),
    ("Capital Expenditures", "cash_flow|purchase_of_plant_property_and_equipment"),
    ("Gross Margin %", "income_statement|total_gross_profit/total_revenue"),
    ("Operating Margin %", "income_statement|total_operating_income/total_revenue"),
    ("Net Profit Margin %", "income_statement|net_income/total_revenue"),
    ("Net Interest Income", "income_statement|net_interest_income"),
    ("Net Interest Margin", "bank|net_interest_margin"),
]

# Named ratios and their parameters.
NAMED_RATIOS = {
    "bank|net_interest_margin": dict(statement="income_statement", numerator_tag="net_interest_income",
                                     denominator_tag="total_assets", denominator_statement="balance_sheet",
                                     exclude_financial=False, min_denominator=1e9, min_value=0.0, max_value=20.0),
    "cross|return_on_equity": dict(statement="income_statement", numerator_tag="net_income",
                                   denominator_tag="total_equity", denominator_statement="balance_sheet",
                                   exclude_financial=True, min_denominator=1e8, min_value=0.0, max_value=500.0),
}
# Tags ranked with financial templates included; tags ranked negated.
FINANCIAL_TEMPLATE_TAGS = ("net_interest_income", "net_income")
NEGATED_TAGS = ("purchase_of_plant_property_and_equipment",)
# Margin bounds by denominator tag, and the minimum denominator for revenue.
MARGIN_BOUNDS = {"total_revenue": (0.0, 99.99)}
REVENUE_MIN_DENOMINATOR = 1e9


def parse_metric(spec: str) -> dict:
    """Catalogue spec -> ranking kind and parameters (the ranking API's rules)."""
    if spec in NAMED_RATIOS:
        return {"kind": "ratio", **NAMED_RATIOS[spec]}
    statement, tag = spec.split("|", 1)
    tag = tag.replace(" ", "+")
    if "+" in tag:
        a, b = tag.split("+", 1)
        return {"kind": "sum", "statement": statement, "tag_a": a, "tag_b": b}
    if "/" in tag:
        num, den = tag.split("/", 1)
        lo, hi = MARGIN_BOUNDS.get(den, (None, None))
        return {"kind": "ratio", "statement": statement, "numerator_tag": num, "denominator_tag": den,
                "min_value": lo, "max_value": hi,
                "min_denominator": REVENUE_MIN_DENOMINATOR if den == "total_revenue" else None}
    return {"kind": "metric", "statement": statement, "tag": tag,
            "exclude_financial": tag not in FINANCIAL_TEMPLATE_TAGS,
            "frequency": None if statement == "balance_sheet" else "annual",
            "negate": tag in NEGATED_TAGS}


def single_metrics() -> list[tuple]:
    rows = []
    for label, spec in METRIC_CATALOGUE:
        p = parse_metric(spec)
        if p["kind"] == "metric":
            rows.append((label, p["statement"], p["tag"], p["frequency"], p["negate"], p["exclude_financial"]))
    return rows


CATALOGUE_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("statement", T.StringType()),
    T.StructField("tag", T.StringType()), T.StructField("frequency", T.StringType()),
    T.StructField("negate", T.BooleanType()), T.StructField("exclude_financial", T.BooleanType()),
])


def catalogue_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, single_metrics(), CATALOGUE_SCHEMA)


PAIR_COLS = ["metric", "kind", "statement_a", "tag_a", "statement_b", "tag_b", "exclude_financial", "min_value", "max_value", "min_denominator"]


def pair_metrics() -> list[tuple]:
    """The catalogue's sums and ratios, with both items and the bounds of each."""
    rows = []
    for label, spec in METRIC_CATALOGUE:
        p = parse_metric(spec)
        if p["kind"] == "sum":
            rows.append((label, "sum", p["statement"], p["tag_a"], p["statement"], p["tag_b"], True, None, None, None))
        elif p["kind"] == "ratio":
            rows.append((label, "ratio", p["statement"], p["numerator_tag"], p.get("denominator_statement") or p["statement"],
                         p["denominator_tag"], p.get("exclude_financial", True), p["min_value"], p["max_value"], p["min_denominator"]))
    return rows


def pairs_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, pair_metrics(), "metric string, kind string, statement_a string, tag_a string, statement_b string, "
                         "tag_b string, exclude_financial boolean, min_value double, max_value double, min_denominator double")


def pairs_values_sql() -> str:
    return values_sql(pair_metrics(), PAIR_COLS, ["VARCHAR"] * 6 + ["BOOLEAN"] + ["DOUBLE"] * 3)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, cols, types=None) -> str:
    """``SELECT * FROM (VALUES ...) t(cols)`` for the oracle, with explicit casts."""
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    if types:
        sel = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in zip(cols, types))
    else:
        sel = "*"
    return f"SELECT {sel} FROM (VALUES {body}) AS t({', '.join(cols)})"


def catalogue_values_sql() -> str:
    return values_sql(single_metrics(), ["metric", "statement", "tag", "frequency", "negate", "exclude_financial"],
                      ["VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "BOOLEAN", "BOOLEAN"])


# ---------------------------------------------------------------------------
# SIC -> (sector, industry) rules, keyed by prefix length (2, 3 or 4 digits).
# Built from the public SIC major-group structure: every 2-digit major group gets
# a GICS-style sector; a few 3- and 4-digit groups refine the industry where the
# major group spans several sectors. The most specific prefix wins.
_S_EN, _S_MA, _S_IN, _S_CD, _S_CS = "Energy", "Materials", "Industrials", "Consumer Discretionary", "Consumer Staples"
_S_HC, _S_FI, _S_IT, _S_CO, _S_UT, _S_RE = ("Health Care", "Financials", "Information Technology",
                                            "Communication Services", "Utilities", "Real Estate")
SIC_MAJOR_GROUPS = [
    ("01", _S_CS, "Agricultural Production - Crops"), ("02", _S_CS, "Agricultural Production - Livestock"),
    ("07", _S_CS, "Agricultural Services"), ("08", _S_MA, "Forestry"), ("09", _S_CS, "Fishing, Hunting & Trapping"),
    ("10", _S_MA, "Metal Mining"), ("12", _S_EN, "Coal Mining"), ("13", _S_EN, "Oil & Gas Extraction"),
    ("14", _S_MA, "Nonmetallic Minerals Mining"), ("15", _S_CD, "Homebuilding"),
    ("16", _S_IN, "Heavy Construction"), ("17", _S_IN, "Construction Special Trade Contractors"),
    ("20", _S_CS, "Food & Kindred Products"), ("21", _S_CS, "Tobacco Products"),
    ("22", _S_CD, "Textile Mill Products"), ("23", _S_CD, "Apparel & Textile Products"),
    ("24", _S_MA, "Lumber & Wood Products"), ("25", _S_CD, "Furniture & Fixtures"),
    ("26", _S_MA, "Paper & Allied Products"), ("27", _S_CO, "Printing & Publishing"),
    ("28", _S_MA, "Chemicals & Allied Products"), ("29", _S_EN, "Petroleum Refining"),
    ("30", _S_MA, "Rubber & Plastics Products"), ("31", _S_CD, "Leather Products"),
    ("32", _S_MA, "Stone, Clay, Glass & Concrete"), ("33", _S_MA, "Primary Metals"),
    ("34", _S_IN, "Fabricated Metal Products"), ("35", _S_IN, "Industrial Machinery & Equipment"),
    ("36", _S_IT, "Electronic & Electrical Equipment"), ("37", _S_IN, "Transportation Equipment"),
    ("38", _S_IT, "Instruments & Related Products"), ("39", _S_CD, "Miscellaneous Manufacturing"),
    ("40", _S_IN, "Railroads"), ("41", _S_IN, "Passenger Transit"), ("42", _S_IN, "Trucking & Warehousing"),
    ("43", _S_IN, "Postal Service"), ("44", _S_IN, "Water Transportation"), ("45", _S_IN, "Air Transportation"),
    ("46", _S_EN, "Pipelines"), ("47", _S_IN, "Transportation Services"), ("48", _S_CO, "Communications"),
    ("49", _S_UT, "Electric, Gas & Sanitary Services"), ("50", _S_IN, "Wholesale - Durable Goods"),
    ("51", _S_CS, "Wholesale - Nondurable Goods"), ("52", _S_CD, "Building Materials & Garden Supply"),
    ("53", _S_CD, "General Merchandise Stores"), ("54", _S_CS, "Food Stores"),
    ("55", _S_CD, "Automotive Dealers & Service Stations"), ("56", _S_CD, "Apparel & Accessory Stores"),
    ("57", _S_CD, "Home Furniture & Equipment Stores"), ("58", _S_CD, "Eating & Drinking Places"),
    ("59", _S_CD, "Miscellaneous Retail"), ("60", _S_FI, "Depository Institutions"),
    ("61", _S_FI, "Nondepository Credit Institutions"), ("62", _S_FI, "Security & Commodity Brokers"),
    ("63", _S_FI, "Insurance Carriers"), ("64", _S_FI, "Insurance Agents & Brokers"),
    ("65", _S_RE, "Real Estate"), ("67", _S_FI, "Holding & Investment Offices"),
    ("70", _S_CD, "Hotels & Lodging"), ("72", _S_CD, "Personal Services"), ("73", _S_IN, "Business Services"),
    ("75", _S_CD, "Automotive Repair & Services"), ("76", _S_IN, "Miscellaneous Repair Services"),
    ("78", _S_CO, "Motion Pictures"), ("79", _S_CD, "Amusement & Recreation"), ("80", _S_HC, "Health Services"),
    ("81", _S_IN, "Legal Services"), ("82", _S_CD, "Educational Services"), ("83", _S_HC, "Social Services"),
    ("84", _S_CD, "Museums & Gardens"), ("86", _S_IN, "Membership Organizations"),
    ("87", _S_IN, "Engineering & Management Services"), ("89", _S_IN, "Services, Not Elsewhere Classified"),
]
SIC_REFINEMENTS = [
    ("131", _S_EN, "Crude Petroleum & Natural Gas"), ("138", _S_EN, "Oil & Gas Field Services"),
    ("283", _S_HC, "Pharmaceuticals"), ("2834", _S_HC, "Pharmaceutical Preparations"),
    ("2836", _S_HC, "Biotechnology"), ("284", _S_CS, "Household & Personal Products"),
    ("357", _S_IT, "Technology Hardware"), ("366", _S_IT, "Communications Equipment"),
    ("367", _S_IT, "Electronic Components"), ("3674", _S_IT, "Semiconductors"),
    ("371", _S_CD, "Automobiles & Components"), ("372", _S_IN, "Aerospace & Defense"),
    ("384", _S_HC, "Health Care Equipment"), ("481", _S_CO, "Telecommunication Services"),
    ("483", _S_CO, "Broadcasting"), ("484", _S_CO, "Cable & Satellite"), ("491", _S_UT, "Electric Utilities"),
    ("492", _S_UT, "Gas Utilities"), ("494", _S_UT, "Water Utilities"), ("602", _S_FI, "Commercial Banks"),
    ("6021", _S_FI, "National Commercial Banks"), ("603", _S_FI, "Thrifts & Mortgage Finance"),
    ("631", _S_FI, "Life Insurance"), ("6798", _S_RE, "Real Estate Investment Trusts"),
    ("737", _S_IT, "Software & IT Services"), ("7372", _S_IT, "Software"), ("7374", _S_IT, "IT Services"),
    ("5812", _S_CD, "Restaurants"), ("5961", _S_CD, "Internet & Direct Marketing Retail"),
    ("806", _S_HC, "Health Care Facilities"),
]
SECTOR_FALLBACK = "Other / Nonclassifiable"
INDUSTRY_FALLBACK = "Nonclassifiable"

# Ticker overrides that win over the SIC rules (ticker, sector, industry).
TICKER_OVERRIDES = [
    ("SHW", "Materials", "Paints & Coatings"),
    ("GOOGL", "Communication Services", "Interactive Media & Services"),
    ("GOOG", "Communication Services", "Interactive Media & Services"),
    ("META", "Communication Services", "Interactive Media & Services"),
    ("PINS", "Communication Services", "Interactive Media & Services"),
    ("SNAP", "Communication Services", "Interactive Media & Services"),
    ("MTCH", "Communication Services", "Interactive Media & Services"),
    ("BMBL", "Communication Services", "Interactive Media & Services"),
    ("DIS", "Communication Services", "Movies & Entertainment"),
    ("WBD", "Communication Services", "Movies & Entertainment"),
    ("V", "Information Technology", "IT Services"),
    ("MA", "Information Technology", "IT Services"),
    ("PYPL", "Information Technology", "IT Services"),
    ("FIS", "Information Technology", "IT Services"),
    ("FI", "Information Technology", "IT Services"),
    ("GPN", "Information Technology", "IT Services"),
    ("NKE", "Consumer Discretionary", "Apparel, Accessories & Luxury Goods"),
    ("CROX", "Consumer Discretionary", "Apparel, Accessories & Luxury Goods"),
    ("DECK", "Consumer Discretionary", "Apparel, Accessories & Luxury Goods"),
    ("ONON", "Consumer Discretionary", "Apparel, Accessories & Luxury Goods"),
]


def sic_rule_rows() -> list[tuple[int, int, str, str]]:
    """(level, prefix, sector, industry); level = number of SIC digits in the prefix."""
    return [(len(code), int(code), sector, industry) for code, sector, industry in SIC_MAJOR_GROUPS + SIC_REFINEMENTS]


SIC_RULE_SCHEMA = "level int, prefix int, sector string, industry string"
OVERRIDE_SCHEMA = "ticker string, sector string, industry string"


def sic_rules_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, sic_rule_rows(), SIC_RULE_SCHEMA)


def overrides_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, TICKER_OVERRIDES, OVERRIDE_SCHEMA)


def sic_rules_sql() -> str:
    return values_sql(sic_rule_rows(), ["level", "prefix", "sector", "industry"],
                      ["INTEGER", "INTEGER", "VARCHAR", "VARCHAR"])


def overrides_sql() -> str:
    return values_sql(TICKER_OVERRIDES, ["ticker", "sector", "industry"], ["VARCHAR", "VARCHAR", "VARCHAR"])
