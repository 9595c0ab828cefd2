"""Daily FX: EUR-based reference cubes -> rates to USD."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKBACK_DAYS = 3650


def triangulate_to_usd(cubes: DataFrame, as_of=None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """cubes: (rate_date, currency, rate) with rate = units of ``currency`` per EUR.

    Per day with a USD quote u: USD->USD 1.0, EUR->USD u, X->USD u / r(X).
    Days without a USD quote are skipped; a zero quote gives null (the reference
    writes 1.0 there). Only days within ``lookback_days`` of ``as_of`` are kept.
    One aggregation: a group holds one day's cube (a few dozen currencies).
    """
    d = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    c = cubes.where(F.col("rate_date") >= F.date_sub(d, lookback_days))
    quote = F.struct(F.col("currency").alias("from_currency"), F.col("rate"))
    day = c.groupBy("rate_date").agg(F.max(F.when(F.col("currency") == "USD", F.col("rate"))).alias("_u"),
                                     F.collect_list(F.when(F.col("currency") != "USD", quote)).alias("_others"))

    def rate(currency, value):
        return F.struct(F.lit(currency).alias("from_currency") if isinstance(currency, str) else currency.alias("from_currency"), value.alias("rate"))
    base = F.array(rate("USD", F.lit(1.0)), rate("EUR", F.col("_u")))
    others = F.transform("_others", lambda q: rate(q["from_currency"], F.col("_u") / F.nullif(q["rate"], F.lit(0.0))))
    out = day.where(F.col("_u").isNotNull()).select("rate_date", F.explode(F.concat(base, others)).alias("_q"))
    return out.select("rate_date", "_q.from_currency", F.lit("USD").alias("to_currency"), "_q.rate")
