"""Company rankings: by one metric, by a sum of two line items, by a ratio, and
every catalogue metric in one scan.

Shape of every ranking (the reference's contract):
filter -> latest period per company -> (as-of USD) -> filters -> semi-joins to the
companies that have a name and a ticker -> top k -> names and best tickers. The
limit comes after the semi-joins, so no ranking is short of eligible companies, and
names and tickers are attached to k rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finfacts.functions.numeric import ratio_pct, safe_div
from finfacts.operators.asof import with_asof_rate
from finfacts.operators.latest import latest_by

# Fixed values used by the ranking queries.
FINANCIAL_TEMPLATES = ("financial", "insurance")
REVENUE_TAGS = ("total_revenue", "operating_revenue")
COST_TAGS = ("total_cost_of_revenue", "operating_cost_of_revenue")
PASS_THROUGH_SHARE = 0.99
NO_RANK = 2147483647

LATEST_ORDER = ["period_ending", "fiscal_year", "fiscal_period", "val"]


def recent_from(as_of) -> Column:
    """First day of the two-year recency window ending at ``as_of`` (default today)."""
    d = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    return F.add_months(d, -24)


def statement_filter(std: DataFrame, statement: str, tag: str, frequency: str | None = None,
                     as_of=None, ciks: DataFrame | None = None, recent: bool = True) -> DataFrame:
    """Conjunctive filter: statement, tag, non-null value, optional frequency and recency."""
    cond = (F.col("statement") == statement) & (F.col("tag") == tag) & F.col("val").isNotNull()
    if frequency:
        cond = cond & (F.col("frequency") == frequency)
    if recent:
        cond = cond & (F.col("period_ending") >= recent_from(as_of))
    out = std.where(cond)
    return restrict_ciks(out, ciks)


def restrict_ciks(df: DataFrame, ciks: DataFrame | None) -> DataFrame:
    """Semi-join to a company subset (replaces the reference's literal IN-list)."""
    if ciks is None:
        return df
    return df.join(ciks.select("cik").distinct(), "cik", "left_semi")


def best_ticker(primary_tickers: DataFrame) -> DataFrame:
    """(cik, ticker): smallest (coalesce(rank, 2^31-1), ticker) per company."""
    best = primary_tickers.groupBy("cik").agg(
        F.min(F.struct(F.coalesce(F.col("rank"), F.lit(NO_RANK)).alias("r"), F.col("ticker").alias("t"))).alias("_b"))
    return best.select("cik", F.col("_b.t").alias("ticker"))


def _is_fin(c: str = "company_type") -> Column:
    return F.col(c).isin(*FINANCIAL_TEMPLATES)


def name_and_ticker(scored: DataFrame, companies: DataFrame, primary_tickers: DataFrame) -> DataFrame:
    """Inner joins of the limited ranking to company names and best tickers.

    ``scored`` is the result of a limit and consumed once: Catalyst knows its size and broadcasts it into the ticker
    scan (only the ranked companies' tickers survive); the best ticker is picked per ranked row.
    """
    small = scored
    cols = scored.columns
    key = F.struct(F.coalesce(F.col("rank"), F.lit(NO_RANK)).alias("r"), F.col("ticker").alias("t"))
    t = primary_tickers.select("cik", key.alias("_k")).join(small, "cik", "inner")
    t = t.groupBy(*cols).agg(F.min("_k").alias("_k")).withColumn("ticker", F.col("_k.t")).drop("_k")
    named = companies.select("cik", "entity_name").join(t, "cik", "inner")
    return named.withColumn("name", F.coalesce(F.col("entity_name"), F.lit(""))).drop("entity_name")


def _eligible(scored: DataFrame, companies: DataFrame, primary_tickers: DataFrame) -> DataFrame:
    return scored.join(companies.select("cik"), "cik", "left_semi").join(primary_tickers.select("cik"), "cik", "left_semi")


def _finish(scored: DataFrame, companies, primary_tickers, limit: int, cols: Sequence[str]) -> DataFrame:
    keep = [c for c in cols if c not in ("ticker", "name")]
    # Only companies with a name row and a ticker can rank, so they are sorted out before the limit.
    pre = _eligible(scored, companies, primary_tickers).select(*keep).orderBy(F.col("value").desc(), F.col("cik").asc()).limit(int(limit))
    out = name_and_ticker(pre, companies, primary_tickers)
    out = out.orderBy(F.col("value").desc(), F.col("cik").asc()).limit(int(limit))
    return out.select(*cols)


_OUT_USD = ["cik", "ticker", "name", "period_ending", "fiscal_year", "fiscal_period", "currency", "value"]
_OUT_RATIO = ["cik", "ticker", "name", "period_ending", "fiscal_year", "fiscal_period", "value"]


def _usd_value(df: DataFrame, sign: float = 1.0) -> DataFrame:
    """Keep USD rows and rows with a rate; value = val * (1 or rate) * sign."""
    factor = F.when(F.col("currency") == "USD", F.lit(1.0)).otherwise(F.col("rate"))
    return (df.where((F.col("currency") == "USD") | F.col("rate").isNotNull())
              .withColumn("value", F.col("val") * factor * F.lit(float(sign))))


def _fmt_date(df: DataFrame) -> DataFrame:
    return df.withColumn("period_ending", F.date_format("period_ending", "yyyy-MM-dd"))


def top_by_metric(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, rates: DataFrame,
                  statement: str, tag: str, limit: int = 25, exclude_financial: bool = True,
                  frequency: str | None = "annual", negate: bool = False, ciks: DataFrame | None = None,
                  as_of=None) -> DataFrame:
    """Top companies by the latest value of one line item, converted to USD."""
    keep = F.lit(True)
    if statement == "income_statement" and tag in REVENUE_TAGS:
        # Pass-through revenue: drop companies whose cost of revenue is >= 99% of
        # revenue at the same period. Revenue and cost rows are read in one scan and
        # paired by one aggregation per (cik, period) — no join. With frequency=None
        # no cost row matches (the reference compares with the text 'None').
        cond = ((F.col("statement") == statement) & F.col("tag").isin(tag, *COST_TAGS) & F.col("val").isNotNull()
                & (F.col("period_ending") >= recent_from(as_of)))
        if frequency:
            cond = cond & (F.col("frequency") == frequency)
        base = restrict_ciks(std.where(cond), ciks)
        cost_hit = F.col("tag").isin(*COST_TAGS) if frequency else F.lit(False)
        g = (base.groupBy("cik", "period_ending", "fiscal_year", "fiscal_period")
             .agg(F.max(F.when(F.col("tag") == tag, F.struct("val", "currency", "company_type"))).alias("_r"),
                  F.max(F.when(cost_hit, F.col("val"))).alias("cost_val"))
             .where(F.col("_r").isNotNull())
             .select("cik", "period_ending", "fiscal_year", "fiscal_period", F.col("_r.val").alias("val"),
                     F.col("_r.currency").alias("currency"), F.col("_r.company_type").alias("company_type"),
                     "cost_val"))
        latest = latest_by(g, ["cik"], LATEST_ORDER)
        keep = (F.col("val").isNull() | (F.col("val") <= 0) | F.col("cost_val").isNull() | (F.col("cost_val") <= 0)
                | (safe_div("cost_val", "val") < PASS_THROUGH_SHARE))
    else:
        s = statement_filter(std, statement, tag, frequency, as_of, ciks)
        latest = latest_by(s, ["cik"], LATEST_ORDER, cols=["cik", "period_ending", "fiscal_year", "fiscal_period",
                                                            "val", "currency", "company_type"])
    rated = with_asof_rate(latest, rates, "currency", "period_ending", "rate", how="left")
    scored = _usd_value(rated, -1.0 if negate else 1.0)
    if negate:
        scored = scored.where(F.col("val") < 0)
    if exclude_financial:
        scored = scored.where(~_is_fin())
    scored = scored.where(keep)
    return _fmt_date(_finish(scored, companies, primary_tickers, limit, _OUT_USD).select(*_OUT_USD))


def _pair_latest(std: DataFrame, left: tuple[str, str], right: tuple[str, str], as_of,
                 left_extra: Column | None = None, right_extra: Column | None = None,
                 ciks: DataFrame | None = None, left_attrs: Sequence[str] = ()) -> DataFrame:
    """Pair two line items per (cik, period_ending) with one scan and one aggregation.

    Replaces a self-join: rows of both items are read together and folded with
    ``max(when(item = ...))``. Within an item, several rows at one period are
    resolved by (fiscal_year, fiscal_period, val) descending.
    """
    lcond = (F.col("statement") == left[0]) & (F.col("tag") == left[1])
    rcond = (F.col("statement") == right[0]) & (F.col("tag") == right[1])
    if left_extra is not None:
        lcond = lcond & left_extra
    if right_extra is not None:
        rcond = rcond & right_extra
    base = std.where((F.col("frequency") == "annual") & F.col("val").isNotNull()
                     & (F.col("period_ending") >= recent_from(as_of))
                     & (((F.col("statement") == left[0]) & (F.col("tag") == left[1]))
                        | ((F.col("statement") == right[0]) & (F.col("tag") == right[1]))))
    if ciks is not None:
        base = restrict_ciks(base, ciks)
    lstruct = F.struct(F.col("fiscal_year"), F.col("fiscal_period"), F.col("val"),
                       *[F.col(a) for a in left_attrs])
    rstruct = F.struct(F.col("fiscal_year"), F.col("fiscal_period"), F.col("val"))
    return (base.groupBy("cik", "period_ending")
            .agg(F.max(F.when(lcond, lstruct)).alias("a"), F.max(F.when(rcond, rstruct)).alias("b"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull()))


def top_by_sum(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, rates: DataFrame,
               statement: str, tag_a: str, tag_b: str, limit: int = 25, exclude_financial: bool = True,
               ciks: DataFrame | None = None, as_of=None) -> DataFrame:
    """Top companies by the latest (a + b) of two annual line items, in USD."""
    pairs = _pair_latest(std, (statement, tag_a), (statement, tag_b), as_of, ciks=ciks,
                         left_attrs=("currency", "company_type"))
    summed = pairs.select("cik", "period_ending", F.col("a.fiscal_year").alias("fiscal_year"),
                          F.col("a.fiscal_period").alias("fiscal_period"), F.col("a.currency").alias("currency"),
                          F.col("a.company_type").alias("company_type"),
                          (F.col("a.val") + F.col("b.val")).alias("val"))
    latest = latest_by(summed, ["cik"], LATEST_ORDER)
    rated = with_asof_rate(latest, rates, "currency", "period_ending", "rate", how="left")
    scored = _usd_value(rated)
    if exclude_financial:
        scored = scored.where(~_is_fin())
    return _fmt_date(_finish(scored, companies, primary_tickers, limit, _OUT_USD))


def top_by_ratio(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, statement: str,
                 numerator_tag: str, denominator_tag: str, limit: int = 25, min_value: float | None = None,
                 max_value: float | None = None, min_denominator: float | None = None,
                 denominator_statement: str | None = None, exclude_financial: bool = True,
                 ciks: DataFrame | None = None, as_of=None) -> DataFrame:
    """Top companies by ``round(num / den * 100, 2)`` at the newest period with an
    acceptable denominator. No currency conversion (a ratio is unit-free)."""
    dstmt = denominator_statement or statement
    num_extra = ~_is_fin() if exclude_financial else None
    # A company subset restricts both items; the inner pairing makes that equal to
    # restricting the numerator only, as the reference does.
    pairs = _pair_latest(std, (statement, numerator_tag), (dstmt, denominator_tag), as_of,
                         left_extra=num_extra, ciks=ciks)
    den_ok = F.col("b.val") > 0
    if min_denominator is not None:
        den_ok = den_ok & (F.col("b.val") >= float(min_denominator))
    paired = pairs.where(den_ok).select(
        "cik", "period_ending", F.col("a.fiscal_year").alias("fiscal_year"),
        F.col("a.fiscal_period").alias("fiscal_period"), F.col("a.val").alias("num_val"),
        F.col("b.val").alias("den_val"))
    latest = latest_by(paired, ["cik"], ["period_ending", "fiscal_year", "fiscal_period", "num_val", "den_val"])
    scored = latest.withColumn("value", ratio_pct("num_val", "den_val", 2))
    if min_value is not None:
        scored = scored.where(F.col("value") >= float(min_value))
    if max_value is not None:
        scored = scored.where(F.col("value") <= float(max_value))
    return _fmt_date(_finish(scored, companies, primary_tickers, limit, _OUT_RATIO))


def top_all_metrics(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, rates: DataFrame,
                    catalogue: DataFrame, limit: int = 25, as_of=None) -> DataFrame:
    """Rank every single-item catalogue metric in one scan of the statement table.

    ``catalogue``: (metric, statement, tag, frequency [null = any], negate, exclude_financial).
    Per-metric top-k uses ``row_number`` over ``partitionBy(metric)``; Spark plans
    it with a per-partition group limit before the shuffle, so at most k rows per
    metric and input partition move.
    """
    cat = catalogue
    s = std.where(F.col("val").isNotNull() & (F.col("period_ending") >= recent_from(as_of)))
    j = s.join(cat, (s.statement == cat.statement) & (s.tag == cat.tag)
               & (cat.frequency.isNull() | (s.frequency == cat.frequency)), "inner")
    # The metric's own attributes ride along as keys, so the catalogue is joined once.
    j = j.select("metric", cat.frequency.alias("m_frequency"), "negate", "exclude_financial", s.cik, s.statement, s.tag, s.period_ending,
                 s.fiscal_year, s.fiscal_period, s.val, s.currency, s.company_type)
    latest = latest_by(j, ["metric", "m_frequency", "negate", "exclude_financial", "cik"], LATEST_ORDER)
    cost = (std.where((F.col("statement") == "income_statement") & (F.col("frequency") == "annual")
                      & F.col("tag").isin(*COST_TAGS) & F.col("val").isNotNull()
                      & (F.col("period_ending") >= recent_from(as_of)))
            .groupBy("cik", "period_ending", "fiscal_year", "fiscal_period").agg(F.max("val").alias("cost_val")))
    latest = latest.join(cost, ["cik", "period_ending", "fiscal_year", "fiscal_period"], "left")
    pass_through_applies = ((F.col("statement") == "income_statement") & F.col("tag").isin(*REVENUE_TAGS)
                            & F.coalesce(F.col("m_frequency") == "annual", F.lit(False)))
    keep = (~pass_through_applies | F.col("val").isNull() | (F.col("val") <= 0) | F.col("cost_val").isNull()
            | (F.col("cost_val") <= 0) | (safe_div("cost_val", "val") < PASS_THROUGH_SHARE))
    rated = with_asof_rate(latest, rates, "currency", "period_ending", "rate", how="left")
    factor = F.when(F.col("currency") == "USD", F.lit(1.0)).otherwise(F.col("rate"))
    sign = F.when(F.col("negate"), F.lit(-1.0)).otherwise(F.lit(1.0))
    scored = (rated.where((F.col("currency") == "USD") | F.col("rate").isNotNull())
              .withColumn("value", F.col("val") * factor * sign)
              .where(~F.col("negate") | (F.col("val") < 0))
              .where(~F.col("exclude_financial") | ~_is_fin())
              .where(keep))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("cik").asc())
    pre = (_eligible(scored, companies, primary_tickers)
           .select("metric", "cik", "period_ending", "fiscal_year", "fiscal_period", "currency", "value")
           .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= int(limit)).drop("_r"))
    named = name_and_ticker(pre, companies, primary_tickers)
    out = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(limit))
    return _fmt_date(out.select("metric", "rank", *_OUT_USD))


def top_all_pairs(std: DataFrame, companies: DataFrame, primary_tickers: DataFrame, rates: DataFrame,
                  pairs: DataFrame, limit: int = 25, as_of=None) -> DataFrame:
    """Rank every catalogue sum and ratio in one scan and one aggregation of the statement table.

    ``pairs``: (metric, kind [sum | ratio], statement_a, tag_a, statement_b, tag_b, exclude_financial, min_value,
    max_value, min_denominator). The rules are those of ``top_by_sum`` (in USD) and ``top_by_ratio`` (no currency):
    a ratio's newest period is one with an acceptable denominator, and leaves out financial companies before pairing.
    """
    spec = ["metric", "kind", "exclude_financial", "min_value", "max_value", "min_denominator"]
    items = pairs.select(*spec, F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("statement_a").alias("statement"), F.col("tag_a").alias("tag")),
        F.struct(F.lit("b").alias("side"), F.col("statement_b").alias("statement"), F.col("tag_b").alias("tag")))).alias("_i"))
    items = items.select(*spec, "_i.*")
    s = std.where((F.col("frequency") == "annual") & F.col("val").isNotNull() & (F.col("period_ending") >= recent_from(as_of)))
    wanted = ~F.col("exclude_financial") | ~_is_fin()
    first = (F.col("side") == "a") & ((F.col("kind") == "sum") | wanted)
    g = (s.join(items, ["statement", "tag"]).groupBy(*spec, "cik", "period_ending")
         .agg(F.max(F.when(first, F.struct("fiscal_year", "fiscal_period", "val", "currency", "company_type"))).alias("a"),
              F.max(F.when(F.col("side") == "b", F.struct("fiscal_year", "fiscal_period", "val"))).alias("b"))
         .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    is_sum = F.col("kind") == "sum"
    den = F.col("b.val")
    g = g.where(is_sum | ((den > 0) & (den >= F.coalesce("min_denominator", den))))
    latest = latest_by(g.select(*spec, "cik", "period_ending", "a.fiscal_year", "a.fiscal_period", F.col("a.val").alias("first"), den.alias("second"),
                                "a.currency", "a.company_type"), [*spec, "cik"], ["period_ending"])
    rated = with_asof_rate(latest.where(~is_sum | wanted), rates, "currency", "period_ending", "rate", how="left")
    factor = F.when(F.col("currency") == "USD", F.lit(1.0)).otherwise(F.col("rate"))
    value = F.when(is_sum, (F.col("first") + F.col("second")) * factor).otherwise(ratio_pct("first", "second", 2))
    scored = rated.withColumn("value", value).where(F.col("value").isNotNull()).where(
        (F.col("value") >= F.coalesce("min_value", "value")) & (F.col("value") <= F.coalesce("max_value", "value")))
    scored = scored.withColumn("currency", F.when(is_sum, F.col("currency")))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("cik").asc())
    pre = (_eligible(scored, companies, primary_tickers)
           .select("metric", "cik", "period_ending", "fiscal_year", "fiscal_period", "currency", "value")
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(limit)))
    return _fmt_date(name_and_ticker(pre, companies, primary_tickers).select("metric", "rank", *_OUT_USD))
