"""Backward as-of currency rates as an equi-join (Spark has no public as-of join).

A range join ``rate_date <= period_ending`` keyed only by currency would put
every row of a currency into one task. Instead the rates are forward-filled over
a dense daily calendar per currency, and facts join that calendar on
``(currency, day)``. The calendar is bounded by the rate table itself
(currencies x days between each currency's first and last quote), not by the
fact volume, so it is broadcast once its measured size is known to be small and
shuffled otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_calendar(rates: DataFrame, to_currency: str = "USD", *, ccy: str = "from_currency",
                  date: str = "rate_date", rate: str = "rate") -> tuple[DataFrame, DataFrame]:
    """(calendar, bounds): per currency and day, the latest quote on or before that day.

    calendar: (_ccy, _day, _rate); bounds: (_ccy, _first, _last).
    Several quotes on one day: the largest rate wins (the reference leaves it open).
    """
    r = (rates.where(F.col("to_currency") == to_currency)
         .groupBy(F.col(ccy).alias("_ccy"), F.col(date).alias("_rdate"))
         .agg(F.max(rate).alias("_r")))
    bounds = r.groupBy("_ccy").agg(F.min("_rdate").alias("_first"), F.max("_rdate").alias("_last"))
    days = bounds.select("_ccy", F.explode(F.sequence("_first", "_last")).alias("_day"))
    quotes = r.select(F.col("_ccy").alias("_qccy"), F.col("_rdate").alias("_qday"),
                      F.struct(F.col("_r").alias("v")).alias("_hit"))
    w = Window.partitionBy("_ccy").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    cal = (days.join(quotes, (F.col("_ccy") == F.col("_qccy")) & (F.col("_day") == F.col("_qday")), "left")
           .select("_ccy", "_day", "_hit")
           .withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
           .select("_ccy", "_day", F.col("_hit.v").alias("_rate")))
    return cal, bounds


def fx_calendar(rates: DataFrame, to_currency: str = "USD") -> DataFrame:
    """Storable as-of table: (_ccy, _day, _rate, _first, _last) — per currency and day
    the latest quote on or before it, plus the currency's quote range. Rebuilt when
    the rate table is rebuilt; its size is currencies x days, independent of facts."""
    cal, bounds = rate_calendar(rates, to_currency)
    return cal.join(bounds, "_ccy", "inner").select("_ccy", "_day", "_rate", "_first", "_last")


def as_calendar(rates_or_calendar: DataFrame, to_currency: str = "USD") -> DataFrame:
    """Accept a stored calendar as is, or build one from a rate table."""
    if "_day" in rates_or_calendar.columns:
        return rates_or_calendar
    return fx_calendar(rates_or_calendar, to_currency)


def with_asof_rate(df: DataFrame, rates: DataFrame, ccy_col: str, date_col: str, out: str = "rate",
                   to_currency: str = "USD", how: str = "left") -> DataFrame:
    """Attach the as-of rate (latest ``rate_date <= date_col``) for ``ccy_col`` -> ``to_currency``.

    ``rates`` is a rate table or a stored ``fx_calendar``. No staleness limit.
    Dates before a currency's first quote get null (``how='left'``) or are dropped
    (``how='inner'``); dates after its last quote take the last quote.
    """
    cal = as_calendar(rates, to_currency)
    # bounds: one row per currency (ISO codes: a few hundred at most).
    bounds = cal.select(F.col("_ccy").alias("_bccy"), "_first", "_last").distinct()
    keyed = (df.join(bounds, F.col(ccy_col) == F.col("_bccy"), "left")
             .withColumn("_lookup", F.when(F.col(date_col) >= F.col("_first"),
                                           F.least(F.col(date_col), F.col("_last"))))
             .drop("_bccy", "_first", "_last"))
    days = cal.select(F.col("_ccy").alias("_dccy"), F.col("_day").alias("_dday"), "_rate")
    joined = keyed.join(days, (F.col(ccy_col) == F.col("_dccy")) & (F.col("_lookup") == F.col("_dday")), how)
    return joined.drop("_dccy", "_dday", "_lookup").withColumnRenamed("_rate", out)


def asof_pairs(pairs: DataFrame, rates: DataFrame, ccy_col: str = "currency", date_col: str = "period_ending",
               to_currency: str = "USD") -> DataFrame:
    """Distinct (currency, date) pairs with their as-of rate (null when none)."""
    return with_asof_rate(pairs.select(ccy_col, date_col).distinct(), rates, ccy_col, date_col, "rate", to_currency)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
              span_days: int = 30) -> DataFrame:
    """``left`` with ``right_time`` and ``values`` of the latest ``right`` row of equal ``by`` at or before ``left_time``.

    Left outer: rows without a match, or with a null key or time, get nulls. Of several right rows at one time the
    greatest ``values`` count. Works for any number of keys and any share of rows on one of them:

    * only distinct (key, time) pairs of ``left`` take part in the search, and the result goes back by an equi-join;
    * a key's time line is cut into spans of ``span_days``; pairs and quotes of a span are one window, in which the last
      quote is filled forward;
    * the last quote before each span comes from a window over the spans of a key (not their rows), and enters the
      span's window as a quote at its start.
    """
    by = list(by)
    span = F.floor(F.col("_t").cast("timestamp").cast("long") / F.lit(span_days * 86400)).alias("_span")
    known = lambda df, time: df.where(reduce(and_, [F.col(c).isNotNull() for c in [*by, time]]))
    points = known(left, left_time).select(*by, F.col(left_time).alias("_t")).distinct().select("*", span)
    quotes = known(right, right_time).groupBy(*by, F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    quotes = quotes.select(*by, "_t", span, F.struct(F.col("_t").alias("_at"), "_v").alias("_q"))
    ends = quotes.groupBy(*by, "_span").agg(F.max_by("_q", "_t").alias("_q"))
    spans = points.select(*by, "_span").distinct().withColumn("_asked", F.lit(True)).join(ends, [*by, "_span"], "full_outer")
    before = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_q", F.last("_q", ignorenulls=True).over(before)).where("_asked and _q is not null")
    # 0: carried into the span, 1: quotes, 2: pairs, which see what stands before them.
    rows = (carried.select(*by, "_span", F.lit(None).cast(points.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_kind"), "_q")
            .unionByName(quotes.select(*by, "_span", "_t", F.lit(1).alias("_kind"), "_q"))
            .unionByName(points.select(*by, "_span", "_t", F.lit(2).alias("_kind"), F.lit(None).cast(quotes.schema["_q"].dataType).alias("_q"))))
    upto = Window.partitionBy(*by, "_span").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_q", F.last("_q", ignorenulls=True).over(upto)).where("_kind = 2 and _q is not null")
    found = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_t").alias("_kt"), "_q")
    on = reduce(and_, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(by)] + [F.col(left_time) == F.col("_kt")])
    return left.join(found, on, "left").select(*left.columns, F.col("_q._at").alias(right_time), *[F.col(f"_q._v.{v}").alias(v) for v in values])
