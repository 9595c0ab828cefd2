"""Line-item standardization, presentation metadata and registrant merge.

The reference delegates standardization to an external package whose rules are not
visible; this is **our design**, table-driven and entirely in Catalyst:

* rules ``(company_type, statement, line_item, priority, namespace, tag, kind)``
  map reported tags to line items (``kind`` = ``duration`` or ``instant``);
* a duration fact's period class comes from ``datediff(end, start)`` (``periods``); instant facts follow the fiscal period;
* per (company, statement, line item, period end, class) the rule with the best priority wins, then the latest filing;
* quarters that only longer periods tell are derived: six months - three, nine - six, the year - nine months or - Q1..Q3;
* TTM = sum of four consecutive quarters (instant items: the quarter's value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finfacts.operators.latest import latest_by
from finfacts.session import written
from finfacts.operators.periods import fiscal_years, in_fiscal_year, period_class, quarters_from_ytd, year_label

RULE_SCHEMA = ("company_type string, statement string, line_item string, priority int, namespace string, "
               "tag string, kind string")
DEFAULT_COMPANY_TYPE = "industrial"


def standardize(facts: DataFrame, rules: DataFrame, company_types: DataFrame | None = None) -> DataFrame:
    """facts (cik, namespace, tag, unit, start, end, val, fp, filed) -> annual and quarterly statement rows.

    Fiscal years are the company's own (``periods.fiscal_years``): a filing's ``fy`` and ``fp`` also stand on the earlier
    periods that it repeats for comparison. Quarters that only longer periods tell (year-to-date cash flows, the fourth
    quarter) are derived in the reported unit; half years and nine months serve that only. Differences are exact for
    values of up to six decimal places.
    """
    f = facts.where(F.col("val").isNotNull() & F.col("end").isNotNull())
    if company_types is not None:
        f = f.join(company_types.select("cik", "company_type"), "cik", "left")
    else:
        f = f.withColumn("company_type", F.lit(None).cast("string"))
    f = f.withColumn("company_type", F.coalesce("company_type", F.lit(DEFAULT_COMPANY_TYPE)))
    # rules: one statement schema per company type, hundreds of rows.
    j = f.join(rules, ["company_type", "namespace", "tag"], "inner")
    fp = F.upper(F.coalesce(F.col("fp"), F.lit("")))
    instant = F.col("kind") == "instant"
    cls = F.when(instant, F.when(F.col("start").isNull(), F.when(fp == "FY", "annual").otherwise("quarterly"))) \
        .otherwise(period_class(F.col("start"), F.col("end")))
    j = j.select("cik", "statement", "line_item", "priority", "start", "end", cls.alias("class"), fp.alias("fp"), "val", "unit", "company_type",
                 "namespace", "tag", "kind", F.coalesce(F.col("filed"), F.col("end")).alias("filed"), (-F.col("priority")).alias("_np"))
    picked = latest_by(j.where(F.col("class").isNotNull()), ["cik", "statement", "line_item", "end", "class"], ["_np", "filed", "val"],
                       cols=["cik", "statement", "line_item", "end", "class", "_np", "filed", "val", "fp", "start", "unit", "company_type",
                             "namespace", "tag", "kind"])
    picked = written(picked, "picked")      # read for the fiscal years, the reported rows and the derived ones
    years = fiscal_years(picked.where(F.col("kind") == "duration"))
    placed = in_fiscal_year(picked, years)
    annual = F.col("class") == "annual"
    own = F.when(F.col("fp").rlike("^Q[1-4]$"), F.col("fp")).otherwise(F.concat(F.lit("Q"), F.quarter("end").cast("string")))
    fper = F.when(annual, F.lit("FY")).otherwise(F.coalesce(F.concat(F.lit("Q"), F.col("slot").cast("string")), own))
    fyear = F.when(annual | F.col("fy_end").isNull(), year_label(F.col("end"))).otherwise(year_label(F.col("fy_end")))
    reported = placed.where(F.col("class").isin("annual", "quarterly")).select(
        "cik", "statement", F.col("end").alias("period_ending"), fyear.alias("fiscal_year"), fper.alias("fiscal_period"),
        F.col("class").alias("frequency"), F.col("line_item").alias("tag"), "val", _currency().alias("currency"), "company_type",
        F.concat_ws(":", "namespace", "tag").alias("source"))
    derived = quarters_from_ytd(placed.where(F.col("kind") == "duration"), ["cik", "statement", "line_item", "unit", "company_type"])
    derived = derived.select(
        "cik", "statement", F.col("end").alias("period_ending"), year_label(F.col("fy_end")).alias("fiscal_year"),
        F.concat(F.lit("Q"), F.col("slot").cast("string")).alias("fiscal_period"), F.lit("quarterly").alias("frequency"),
        F.col("line_item").alias("tag"), "val", _currency().alias("currency"), "company_type",
        F.concat(F.lit("derived: "), F.col("line_item"), F.lit(" (Q"), F.col("slot").cast("string"), F.lit(")")).alias("source"))
    return reported.unionByName(derived)


def _currency():
    return F.when(F.col("unit").rlike("^[A-Z]{3}$"), F.col("unit"))


def with_ttm(rows: DataFrame, instant_statements=("balance_sheet",)) -> DataFrame:
    """``rows`` with ``ttm``: on quarterly rows the sum of four consecutive quarters ending there, balance-sheet items
    the quarter's own value; null where a quarter is missing.

    Quarters are numbered by year and month of their end, so four quarters count only if they lie in one year's
    span, however many the company left out. The sum is exact for values of up to four decimal places.
    """
    r = rows.withColumn("_m", F.year("period_ending") * 12 + F.month("period_ending"))
    # Ends vary by days, so a quarter may end in the next month: 4 quarters span 9 months, one more or less.
    w = Window.partitionBy("cik", "statement", "tag", "frequency").orderBy("_m").rangeBetween(-10, 0)
    s = F.sum(F.col("val").cast("decimal(38,4)")).over(w).cast("double")
    n, first = F.count("val").over(w), F.min(F.when(F.col("val").isNotNull(), F.col("_m"))).over(w)
    inst = F.col("statement").isin(*instant_statements)
    val = F.when(inst, F.col("val")).when((n == 4) & (F.col("_m") - first >= 8), s)
    return r.withColumn("ttm", F.when(F.col("frequency") == "quarterly", val)).drop("_m")


def ttm(std: DataFrame, instant_statements=("balance_sheet",)) -> DataFrame:
    """Trailing twelve months at each quarter (``with_ttm``) as rows of frequency ``ttm``."""
    r = with_ttm(std.where(F.col("frequency") == "quarterly"), instant_statements)
    return r.where(F.col("ttm").isNotNull()).withColumn("val", F.col("ttm")).withColumn("frequency", F.lit("ttm")).select(*std.columns)


PRESENTATION_KEYS = ["company_type", "statement", "tag"]
PRESENTATION_ATTRS = ["label", "description", "parent", "sequence", "factor", "balance", "unit"]


def presentation_dim(rows: DataFrame, load_order: str = "load_seq") -> DataFrame:
    """One row per (company_type, statement, tag); the latest load's attributes win."""
    w = rows.groupBy(*PRESENTATION_KEYS).agg(F.max_by(F.struct(*PRESENTATION_ATTRS), load_order).alias("_a"))
    return w.select(*PRESENTATION_KEYS, *[F.col(f"_a.{a}").alias(a) for a in PRESENTATION_ATTRS])


def company_type_of(std: DataFrame) -> DataFrame:
    """(cik, company_type): the type on the company's latest row, else ``industrial``."""
    t = std.where(F.col("company_type").isNotNull() & (F.col("company_type") != ""))
    t = t.groupBy("cik").agg(F.max_by("company_type", F.struct("period_ending", "company_type")).alias("company_type"))
    return t


def standardized_statements(std: DataFrame, presentation: DataFrame, sources: DataFrame | None = None,
                            frequency: str = "annual", ciks: DataFrame | None = None) -> DataFrame:
    """Statement rows with presentation metadata for the three statements.

    Missing definitions default to label = tag, factor ``+``, unit ``monetary``,
    empty description and balance.
    """
    s = std.where((F.col("frequency") == frequency)
                  & F.col("statement").isin("income_statement", "balance_sheet", "cash_flow"))
    if ciks is not None:
        s = s.join(ciks.select("cik").distinct(), "cik", "left_semi")
    ct = company_type_of(s).withColumnRenamed("company_type", "_ct")
    s = s.join(ct, "cik", "left").withColumn("_ct", F.coalesce("_ct", F.lit(DEFAULT_COMPANY_TYPE)))
    p = presentation.withColumnRenamed("company_type", "_ct")
    s = s.join(p, ["_ct", "statement", "tag"], "left")
    if sources is not None:
        s = s.join(sources.select("cik", "statement", "tag", "period_ending", "source"),
                   ["cik", "statement", "tag", "period_ending"], "left")
    else:
        s = s.withColumn("source", F.lit(None).cast("string"))
    return s.select("cik", F.col("_ct").alias("company_type"), "statement",
                    F.date_format("period_ending", "yyyy-MM-dd").alias("period_ending"), "fiscal_period",
                    "fiscal_year", "currency", "tag", F.col("val").alias("value"),
                    F.coalesce("source", F.lit("")).alias("source"),
                    F.coalesce("label", "tag").alias("label"), F.coalesce("description", F.lit("")).alias("description"),
                    "parent", "sequence", F.coalesce("factor", F.lit("+")).alias("factor"),
                    F.coalesce("balance", F.lit("")).alias("balance"), F.coalesce("unit", F.lit("monetary")).alias("unit"))


def merge_registrants(std: DataFrame, canonical: DataFrame, priorities: DataFrame) -> DataFrame:
    """Fold the rows of related registrants into their primary company.

    canonical: (cik, primary_cik); priorities: (cik, priority) — 0 first; a cik
    without a priority ranks after all listed ones. Where several registrants
    report the same line item for the same period, the best-priority one wins.

    Only companies in a multi-registrant group can collide, so only their rows are
    aggregated; every other row (a company's key is unique in the statement table)
    passes straight through without a shuffle where AQE finds the group set small. The
    statements are read once: their rows are written with their group, then told apart.
    """
    linked = canonical.where(F.col("cik") != F.col("primary_cik"))
    members = linked.select("cik").union(linked.select(F.col("primary_cik").alias("cik"))).distinct()
    key = ["primary_cik", "statement", "tag", "period_ending", "fiscal_year", "fiscal_period", "frequency"]
    rest = [c for c in std.columns if c not in key and c != "cik"]
    pr = priorities.groupBy("cik").agg(F.min("priority").alias("_prio"))
    group = (members.join(canonical, "cik", "left").join(pr, "cik", "left")
             .select("cik", F.coalesce("primary_cik", "cik").alias("primary_cik"), F.coalesce("_prio", F.lit(2147483647)).alias("_prio")))
    rows = written(std.join(group, "cik", "left"), "registrants")
    plain = rows.where(F.col("primary_cik").isNull()).select(
        F.col("cik"), F.col("cik").alias("source_cik"), *[c for c in key if c != "primary_cik"], *rest)
    s = rows.where(F.col("primary_cik").isNotNull())
    picked = latest_by(s, key, ["_prio", "cik"], cols=key + ["_prio", "cik"] + rest, descending=False)
    merged = picked.select(F.col("primary_cik").alias("cik"), F.col("cik").alias("source_cik"),
                           *[c for c in key if c != "primary_cik"], *rest)
    return plain.unionByName(merged)
