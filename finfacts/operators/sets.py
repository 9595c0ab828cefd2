"""Company sets and latest-period lookups (M25, M26) and location decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.operators.joins import literal_table
from finfacts.operators.latest import latest_by
from finfacts.operators.rank import recent_from

# Revenue-like tags for "has revenue", and asset tags for "productive".
HAS_REVENUE_TAGS = ("total_revenue", "operating_revenue", "total_interest_income", "premiums_earned",
                    "revenues_excl_interest_dividends", "total_noninterest_income")
PRODUCTIVE_TAGS = ("net_ppe", "net_inventory", "goodwill", "intangible_assets")


def latest_period(std: DataFrame, statement: str, tag: str, frequency: str | None = None,
                  company_type: str | None = None, currency: str | None = None) -> DataFrame:
    """One row: the newest period_ending with a value for the filter (null when none)."""
    c = (F.col("statement") == statement) & (F.col("tag") == tag) & F.col("val").isNotNull()
    for col, v in (("frequency", frequency), ("company_type", company_type), ("currency", currency)):
        if v:
            c = c & (F.col(col) == v)
    return std.where(c).agg(F.max("period_ending").alias("latest_period"))


def latest_metric(std: DataFrame, tag: str, frequency: str = "annual") -> DataFrame:
    """(cik, val): latest non-null value by fiscal_year, then period_ending."""
    s = std.where((F.col("tag") == tag) & (F.col("frequency") == frequency) & F.col("val").isNotNull())
    return latest_by(s, ["cik"], ["fiscal_year", "period_ending", "val"], cols=["cik", "fiscal_year", "period_ending", "val"]) \
        .select("cik", "val")


def latest_revenue(std: DataFrame) -> DataFrame:
    """(cik, revenue): latest annual non-zero revenue; total_revenue beats operating_revenue."""
    s = std.where(F.col("tag").isin("total_revenue", "operating_revenue") & (F.col("frequency") == "annual")
                  & F.col("val").isNotNull() & (F.col("val") != 0))
    s = s.withColumn("_pref", F.when(F.col("tag") == "total_revenue", 1).otherwise(0))
    return latest_by(s, ["cik"], ["fiscal_year", "period_ending", "_pref", "val"],
                     cols=["cik", "fiscal_year", "period_ending", "_pref", "val"]).select("cik", F.col("val").alias("revenue"))


def companies_with_any(std: DataFrame, tags, positive: bool = False, as_of=None) -> DataFrame:
    """Distinct ciks with an annual value of one of ``tags`` in the last two years
    (non-zero, or > 0 when ``positive``)."""
    v = F.col("val") > 0 if positive else F.col("val") != 0
    s = std.where((F.col("frequency") == "annual") & F.col("val").isNotNull() & v
                  & (F.col("period_ending") >= recent_from(as_of)) & F.col("tag").isin(*tags))
    return s.select("cik").distinct()


# US state and territory codes (USPS) and Canadian province codes used
# in filing addresses. Other country codes come from a user-supplied table.
US_STATES = [
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"), ("CA", "California"),
    ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"), ("DC", "District of Columbia"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"), ("IL", "Illinois"),
    ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"), ("KY", "Kentucky"), ("LA", "Louisiana"),
    ("ME", "Maine"), ("MD", "Maryland"), ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"),
    ("MS", "Mississippi"), ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"), ("OR", "Oregon"),
    ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"), ("SD", "South Dakota"),
    ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"), ("VT", "Vermont"), ("VA", "Virginia"),
    ("WA", "Washington"), ("WV", "West Virginia"), ("WI", "Wisconsin"), ("WY", "Wyoming"),
    ("GU", "Guam"), ("PR", "Puerto Rico"), ("VI", "Virgin Islands, U.S."), ("X1", "United States"),
]
CANADA = [
    ("A0", "Alberta, Canada"), ("A1", "British Columbia, Canada"), ("A2", "Manitoba, Canada"),
    ("A3", "New Brunswick, Canada"), ("A4", "Newfoundland, Canada"), ("A5", "Nova Scotia, Canada"),
    ("A6", "Ontario, Canada"), ("A7", "Prince Edward Island, Canada"), ("A8", "Quebec, Canada"),
    ("A9", "Saskatchewan, Canada"), ("B0", "Yukon, Canada"),
]


def location_dim(spark, extra: DataFrame | None = None) -> DataFrame:
    """(code, name, is_us_state); ``extra`` (code, name) adds or overrides codes."""
    base = literal_table(spark, [(c, n, True) for c, n in US_STATES] + [(c, n, False) for c, n in CANADA],
                                 "code string, name string, is_us_state boolean")
    if extra is not None:
        e = extra.select("code", "name", F.lit(False).alias("is_us_state"))
        base = base.join(e.select("code"), "code", "left_anti").unionByName(e)
    return base


def decode_location(df: DataFrame, code_col: str, locations: DataFrame, prefix: str) -> DataFrame:
    """Adds ``<prefix>_name``, ``<prefix>_state`` and ``<prefix>_country`` (state vs country split)."""
    loc = locations.select(F.col("code").alias("_lc"), F.col("name").alias("_ln"),
                                       F.col("is_us_state").alias("_us"))  # a few hundred codes
    j = df.join(loc, F.col(code_col) == F.col("_lc"), "left")
    return (j.withColumn(f"{prefix}_name", F.col("_ln"))
             .withColumn(f"{prefix}_state", F.when(F.col("_us"), F.col("_ln")))
             .withColumn(f"{prefix}_country", F.when(~F.col("_us"), F.col("_ln")))
             .drop("_lc", "_ln", "_us"))
