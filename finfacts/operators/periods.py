"""Period algebra: fiscal years of a company, and the quarters that its longer periods imply.

A duration is known by its length: a quarter, half a year, nine months or a year. Quarterly cash flows are reported
from the start of the year on, so their quarters are differences (nine months - six months), and a fourth quarter is
the year less what came before. Which fiscal year a period belongs to follows from dates alone: it is the year that
holds the period, whatever month it ends in.

A year ends in the calendar year that its last week begins in: fiscal years of 52 or 53 weeks may end in early January.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Period classes by days from start to end.
CLASSES = (("quarterly", 80, 100), ("half", 165, 200), ("nine", 250, 290), ("annual", 350, 380))
SLACK = 7                 # days by which starts and ends of one fiscal calendar may differ
LONGEST_YEAR = 380        # a period that ends later after a fiscal year's end doesn't belong to the next one
QUARTER_DAYS = 365.25 / 4
_MONEY = "decimal(38,6)"  # differences are exact where all values of an item's year fit it, else those of doubles


def period_class(start: Column, end: Column) -> Column:
    """``quarterly``, ``half``, ``nine`` or ``annual``; null for other lengths and for instants."""
    days = F.datediff(end, start)
    out = None
    for name, least, most in CLASSES:
        out = F.when(days.between(least, most), name) if out is None else out.when(days.between(least, most), name)
    return out


def year_label(end: Column) -> Column:
    """Fiscal year by its last day."""
    return F.year(F.date_sub(end, SLACK))


def fiscal_years(periods: DataFrame) -> DataFrame:
    """(cik, years): a company's fiscal years, one row a company.

    periods: (cik, start, end, class, fp) duration rows. Years are those of annual periods filed as full years (``fp``
    FY or none: sums over the last twelve months of a quarterly filing make no calendar). Half years of second and nine
    months of third quarters start a year too, which counts only where no whole year holds a period.
    """
    fp = F.coalesce(F.upper("fp"), F.lit(""))
    whole = (F.col("class") == "annual") & fp.isin("FY", "")
    begun = ((F.col("class") == "half") & (fp == "Q2")) | ((F.col("class") == "nine") & (fp == "Q3"))
    end = F.when(whole, F.col("end")).otherwise(F.date_sub(F.add_months("start", 12), 1))
    # Sorted by end, then latest start.
    y = periods.where(whole | begun).select("cik", F.struct(end.alias("end"), (-F.unix_date("start")).alias("back"), whole.alias("whole")).alias("y"))
    return y.groupBy("cik").agg(F.array_sort(F.collect_set("y")).alias("years"))


def in_fiscal_year(periods: DataFrame, years: DataFrame) -> DataFrame:
    """``periods`` (cik, start, end, class, ...) with ``fy_start``, ``fy_end`` and ``slot`` (quarter of the year at the period's end).

    Start is null for instants. The fiscal year is, in this order: the earliest-ending whole year that holds the period;
    a begun one that does; the year after the latest whole one that ended at most ``LONGEST_YEAR`` days before; for
    half years and nine months the year that starts with them. Otherwise the three are null.
    """
    first = F.coalesce("start", "end")

    def holds(y):
        return (F.date_from_unix_date(-y["back"]) <= F.date_add(first, SLACK)) & (F.col("end") <= F.date_add(y["end"], SLACK))

    p = periods.join(years, "cik", "left").withColumn("years", F.coalesce("years", F.array().cast("array<struct<end:date,back:int,whole:boolean>>")))
    holding = F.filter("years", holds)
    p = p.withColumn("_in", F.coalesce(F.try_element_at(F.filter(holding, lambda y: y["whole"]), F.lit(1)), F.try_element_at(holding, F.lit(1))))
    p = p.withColumn("_before", F.array_max(F.transform(F.filter("years", lambda y: y["whole"] & (y["end"] < F.col("end"))), lambda y: y["end"])))
    follows = F.datediff("end", "_before") <= LONGEST_YEAR
    own = F.col("class").isin("half", "nine")
    start = (F.when(F.col("_in").isNotNull(), F.date_from_unix_date(-F.col("_in.back"))).when(follows, F.date_add("_before", 1)).when(own, F.col("start")))
    end = (F.when(F.col("_in").isNotNull(), F.col("_in.end")).when(follows, F.add_months("_before", 12))
           .when(own, F.date_sub(F.add_months("start", 12), 1)))
    p = p.withColumn("fy_start", start).withColumn("fy_end", end).drop("years", "_in", "_before")
    slot = F.round((F.datediff("end", "fy_start") + 1) / F.lit(QUARTER_DAYS)).cast("int")
    return p.withColumn("slot", F.when(slot.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(4), slot))))


def _solve(field: str, kind: str):
    """Sums from a fiscal year's start to the end of its quarters 1 to 4, from quarters ``_q`` and sums ``_y`` (arrays of
    the rows that tell each): the reported quarters' sum where all are reported, else as reported, else from a sum and a
    quarter beside it; the whole year first of all as reported. Null where nothing tells."""
    only = lambda rows: F.when(F.size(rows) == 1, F.get(rows, F.lit(0))[field]).cast(kind)
    q, y = F.transform("_q", only), F.transform("_y", only)
    none = F.array().cast(f"array<{kind}>")
    added = F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.concat(none, F.slice(y, 1, 1)), lambda done, i: F.concat(
        done, F.array((F.get(done, i - 1) + F.get(q, i)).cast(kind))))
    forward = F.aggregate(F.sequence(F.lit(0), F.lit(3)), none, lambda done, i: F.concat(
        done, F.array(F.coalesce(F.get(added, i), F.get(y, i), F.get(done, i - 1) + F.get(q, i)).cast(kind))))
    return F.aggregate(F.sequence(F.lit(2), F.lit(0), F.lit(-1)), F.slice(forward, 4, 1), lambda done, i: F.concat(
        F.array(F.coalesce(F.get(forward, i), F.get(done, F.lit(0)) - F.get(q, i + 1)).cast(kind)), done))


def quarters_from_ytd(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quarters that follow from longer periods and are not reported themselves: ``keys``, fy_start, fy_end, slot, end, val.

    periods: rows of ``in_fiscal_year`` with ``keys`` (company, item, unit ...) and ``val``. Within a fiscal year y1..y4
    are the sums from its start (first quarter, half, nine months, year) and q1..q4 its quarters. Sums follow from
    reported quarters, else are as reported, else from a neighbour and a quarter between; quarters from two neighbouring
    sums, so that a year's quarters add up to it. A quarter or sum reported more
    than once for different dates is uncertain and left out. One aggregation per item and fiscal year, whose rows have
    different ends within it, with no window and no self-join.
    """
    from_start = F.abs(F.datediff("start", "fy_start")) <= SLACK
    held = periods.where(F.col("fy_start").isNotNull() & F.col("val").isNotNull() & F.col("class").isNotNull() & F.col("start").isNotNull())
    # What a row tells: quarter k, or the sum of the first k quarters.
    told = F.when(F.col("class") == "quarterly", F.col("slot")).when(from_start, F.when(F.col("class") == "half", 2).when(F.col("class") == "nine", 3).otherwise(4))
    dec = F.col("val").try_cast(_MONEY)
    row = F.struct((F.col("class") == "quarterly").alias("quarter"), told.alias("k"), "start", "end", "val", dec.alias("dec"),
                   dec.cast("double").eqNullSafe(F.col("val")).alias("exact"))
    g = held.where(told.isNotNull()).groupBy(*keys, "fy_start").agg(F.max("fy_end").alias("fy_end"), F.collect_list(row).alias("_rows"))
    ks = F.sequence(F.lit(1), F.lit(4))
    rows_of = lambda quarter: F.transform(ks, lambda k: F.filter("_rows", lambda r: (r["quarter"] == quarter) & (r["k"] == k)))
    g = g.select(*keys, "fy_start", "fy_end", F.forall("_rows", lambda r: r["exact"]).alias("_exact"), rows_of(True).alias("_q"), rows_of(False).alias("_y"))
    # The first quarter is a sum from the start, too.
    first = F.filter(F.get("_q", F.lit(0)), lambda r: F.abs(F.datediff(r["start"], F.col("fy_start"))) <= SLACK)
    g = g.withColumn("_y", F.concat(F.array(first), F.slice("_y", 2, 3)))
    sums = F.when(F.col("_exact"), _solve("dec", _MONEY))
    g = g.withColumn("_dec", sums).withColumn("_dbl", F.when(~F.col("_exact"), _solve("val", "double")))
    step = lambda arr: F.transform(ks, lambda k: (F.get(arr, k - 1) - F.when(k == 1, F.lit(0)).otherwise(F.get(arr, k - 2))).cast("double"))
    g = g.withColumn("_val", F.when(F.col("_exact"), step(F.col("_dec"))).otherwise(step(F.col("_dbl"))))
    end = lambda k: F.coalesce(F.get(F.get("_y", k - 1), F.lit(0))["end"], F.date_sub(F.get(F.get("_q", k), F.lit(0))["start"], 1))
    found = F.transform(ks, lambda k: F.struct(k.alias("slot"), end(k).alias("end"), F.get("_val", k - 1).alias("val"), F.size(F.get("_q", k - 1)).alias("n")))
    out = g.select(*keys, "fy_start", "fy_end", F.explode(F.filter(found, lambda x: (x["n"] == 0) & x["val"].isNotNull() & x["end"].isNotNull())).alias("_d"))
    return out.select(*keys, "fy_start", "fy_end", "_d.slot", "_d.end", "_d.val")
