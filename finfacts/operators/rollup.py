"""Sector / industry / sub-industry roll-ups of each company's latest metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.functions.numeric import exact_sum, round_to
from finfacts.operators.latest import latest_by
from finfacts.operators.rank import PASS_THROUGH_SHARE, recent_from

# The line items a roll-up reads.
ROLLUP_TAGS = ("total_revenue", "operating_revenue", "total_cost_of_revenue", "operating_cost_of_revenue",
               "net_income", "total_assets")
LEVELS = {"sector": ("sector",), "industry": ("sector", "industry"),
          "sub_industry": ("sector", "industry", "sub_industry")}


def company_metrics(std: DataFrame, as_of=None) -> DataFrame:
    """Per company: revenue (0 when pass-through), net_income, assets, has_revenue.

    The latest annual row per (cik, tag) within two years is taken **including
    null values**: a null latest value hides an older non-null one.
    """
    s = std.where((F.col("frequency") == "annual") & F.col("tag").isin(*ROLLUP_TAGS)
                  & (F.col("period_ending") >= recent_from(as_of)))
    latest = latest_by(s, ["cik", "tag"], ["period_ending", "fiscal_year", "fiscal_period", "val"],
                       cols=["cik", "tag", "period_ending", "fiscal_year", "fiscal_period", "val"])

    def pick(tag: str) -> Column:
        return F.max(F.when(F.col("tag") == tag, F.col("val")))

    m = latest.groupBy("cik").agg(
        F.coalesce(pick("total_revenue"), pick("operating_revenue")).alias("rev"),
        F.coalesce(pick("total_cost_of_revenue"), pick("operating_cost_of_revenue")).alias("cost"),
        pick("net_income").alias("net_income"), pick("total_assets").alias("assets"))
    share = F.col("cost") / F.nullif(F.col("rev"), F.lit(0))
    has_rev = F.when((F.col("rev") > 0) & (F.col("cost").isNull() | (F.col("cost") <= 0)
                                           | (share < PASS_THROUGH_SHARE)), 1).otherwise(0)
    pass_through = (F.col("rev") > 0) & (F.col("cost") > 0) & (share >= PASS_THROUGH_SHARE)
    revenue = F.when(pass_through, F.lit(0.0)).otherwise(F.coalesce(F.col("rev"), F.lit(0.0)))
    return m.select("cik", revenue.alias("revenue"), "net_income", "assets", has_rev.alias("has_revenue"))


def _aggregates() -> list[Column]:
    ni = F.col("net_income")
    rev_pos = F.when(F.col("revenue") > 0, F.col("revenue")).otherwise(F.lit(0.0))
    assets_pos = F.when(F.col("assets") > 0, F.col("assets")).otherwise(F.lit(0.0))
    ni0 = F.when(ni.isNotNull(), ni).otherwise(F.lit(0.0))
    n = F.count(F.lit(1))
    sum_ni, sum_rev, sum_assets = exact_sum(ni0), exact_sum(rev_pos), exact_sum(assets_pos)
    return [
        n.alias("companies"),
        round_to(F.lit(100.0) * F.sum("has_revenue").cast("double") / n, 1).alias("with_revenue"),
        round_to(F.lit(100.0) * F.sum(F.when(ni > 0, 1).otherwise(0)).cast("double")
                / F.nullif(F.sum(F.when(ni.isNotNull(), 1).otherwise(0)), F.lit(0)), 1).alias("profitable"),
        round_to(sum_rev, 0).alias("total_revenue"),
        round_to(sum_ni, 0).alias("total_net_income"),
        round_to(sum_assets, 0).alias("total_assets"),
        round_to(F.lit(100.0) * sum_ni / F.nullif(sum_rev, F.lit(0.0)), 2).alias("aggregate_net_margin"),
        round_to(F.lit(100.0) * sum_ni / F.nullif(sum_assets, F.lit(0.0)), 2).alias("aggregate_roa"),
    ]


def _base(classified: DataFrame, std: DataFrame, as_of) -> DataFrame:
    m = company_metrics(std, as_of)
    b = classified.join(m, "cik", "left")
    return b.select("sector", "industry", "sub_industry", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    "net_income", F.coalesce("assets", F.lit(0.0)).alias("assets"), "has_revenue")


def sector_aggregates(classified: DataFrame, std: DataFrame, sector: str | None = None, industry: str | None = None,
                      as_of=None) -> DataFrame:
    """Grain follows the filter: none -> sectors; sector -> its industries; industry -> its sub-industries."""
    b = _base(classified, std, as_of)
    if industry:
        b, keys = b.where(F.col("industry") == industry), LEVELS["sub_industry"]
    elif sector:
        b, keys = b.where(F.col("sector") == sector), LEVELS["industry"]
    else:
        keys = LEVELS["sector"]
    out = b.groupBy(*keys).agg(*_aggregates())
    for k in ("industry", "sub_industry"):
        if k not in keys:
            out = out.withColumn(k, F.lit(None).cast("string"))
    return out.select("sector", "industry", "sub_industry", *[c for c in out.columns if c not in
                                                             ("sector", "industry", "sub_industry")])


def sector_rollup(classified: DataFrame, std: DataFrame, as_of=None) -> DataFrame:
    """All three grains in one pass (GROUPING SETS); ``level`` names the grain of a row."""
    b = _base(classified, std, as_of)
    out = b.groupingSets([["sector"], ["sector", "industry"], ["sector", "industry", "sub_industry"]],
                         "sector", "industry", "sub_industry").agg(*_aggregates(), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "sector").when(F.col("_g") == 1, "industry").otherwise("sub_industry")
    return out.withColumn("level", level).drop("_g")


def sector_medians(classified: DataFrame, std: DataFrame, as_of=None, accuracy: int | None = None) -> DataFrame:
    """Median net margin and return on assets (%) of the companies of each sector, industry and sub-industry, in one pass.

    A company counts where its divisor is positive and its net income known. Exact by default: a group holds its
    distinct values once. With ``accuracy`` the medians come from quantile sketches, which partial aggregations merge
    whatever a group's size; their rank is off by at most 1/accuracy of the group's companies.
    """
    b = _base(classified, std, as_of)
    pct = lambda d: F.when((F.col(d) > 0) & F.col("net_income").isNotNull(), F.lit(100.0) * F.col("net_income") / F.col(d))
    b = b.select("sector", "industry", "sub_industry", pct("revenue").alias("margin"), pct("assets").alias("roa"))
    middle = (lambda c: F.median(c)) if accuracy is None else (lambda c: F.percentile_approx(c, 0.5, accuracy))
    out = b.groupingSets([["sector"], ["sector", "industry"], ["sector", "industry", "sub_industry"]], "sector", "industry", "sub_industry").agg(
        F.count("margin").alias("with_margin"), round_to(middle("margin"), 6).alias("median_net_margin"),
        F.count("roa").alias("with_roa"), round_to(middle("roa"), 6).alias("median_roa"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 3, "sector").when(F.col("_g") == 1, "industry").otherwise("sub_industry")
    return out.withColumn("level", level).drop("_g")
