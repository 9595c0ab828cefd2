"""Industry classification (SIC code -> sector / industry / sub-industry) and the
company filter built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.functions.ids import sic4
from finfacts.operators.latest import latest_by

SECTOR_FALLBACK = "Other / Nonclassifiable"
INDUSTRY_FALLBACK = "Nonclassifiable"


def classify(sic_facts: DataFrame, primary_tickers: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """(cik, sic4, sector, industry, sub_industry) for every listed company with a SIC code.

    sic_facts: (id, cik, val, val_text, end_date, filed) — the SIC code in ``val``
    and its description in ``val_text``; the latest by (end_date, filed, id) wins,
    separately for code and description. rules: (level, prefix, sector, industry),
    a literal table (broadcast). overrides: (ticker, sector, industry), by primary ticker.
    """
    tradeable = primary_tickers.select("cik").distinct()
    f = sic_facts.join(tradeable, "cik", "left_semi")
    order = ["end_date", "filed", "id"]
    code = latest_by(f.where(F.col("val").isNotNull()), ["cik"], order, cols=["cik", *order, "val"])
    code = code.select("cik", sic4("val").alias("sic4"))
    descr = latest_by(f.where(F.col("val_text").isNotNull()), ["cik"], order, cols=["cik", *order, "val_text"])
    descr = descr.select("cik", F.col("val_text").alias("descr"))
    ovr = (primary_tickers.join(overrides, "ticker", "inner")
           .groupBy("cik").agg(F.max("sector").alias("ovr_sector"), F.max("industry").alias("ovr_industry")))
    out = code
    for level, div in ((4, 1), (3, 10), (2, 100)):
        r = rules.where(F.col("level") == level).select(
            F.col("prefix").alias(f"_p{level}"), F.col("sector").alias(f"_s{level}"),
            F.col("industry").alias(f"_i{level}"))
        out = out.join(r, F.floor(F.col("sic4") / div).cast("int") == F.col(f"_p{level}"), "left")
    out = out.join(descr, "cik", "left").join(ovr, "cik", "left")
    return out.select(
        "cik", "sic4",
        F.coalesce("ovr_sector", "_s4", "_s3", "_s2", F.lit(SECTOR_FALLBACK)).alias("sector"),
        F.coalesce("ovr_industry", "_i4", "_i3", "_i2", F.lit(INDUSTRY_FALLBACK)).alias("industry"),
        F.coalesce(F.col("descr"), F.concat(F.lit("SIC "), F.col("sic4").cast("string"))).alias("sub_industry"))


def ciks_in(classified: DataFrame, sector: str | None = None, industry: str | None = None) -> DataFrame | None:
    """Companies of a sector and/or industry; None when neither is given (no filter).
    An empty result is an empty DataFrame, so a ranking over it is empty too."""
    if not sector and not industry:
        return None
    cond = F.lit(True)
    if sector:
        cond = cond & (F.col("sector") == sector)
    if industry:
        cond = cond & (F.col("industry") == industry)
    return classified.where(cond).select("cik")


def list_sectors(classified: DataFrame) -> DataFrame:
    g = classified.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("label", F.format_string("%s (%d)", F.col("sector"), F.col("n")))


def list_industries(classified: DataFrame, sector: str | None = None) -> DataFrame:
    c = classified.where(F.col("sector") == sector) if sector else classified
    g = c.groupBy("sector", "industry").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("label", F.format_string("%s (%d)", F.col("industry"), F.col("n")))
