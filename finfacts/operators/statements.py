"""Statement transforms: USD conversion, positional growth, wide / transposed shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finfacts.functions.numeric import growth as growth_expr
from finfacts.functions.text import fiscal_year_label, humanize, period_label
from finfacts.operators.asof import with_asof_rate
from finfacts.operators.latest import first_n_periods, period_index
from finfacts.operators.standardize import with_ttm
from finfacts.session import written


def is_monetary(tag: Column) -> Column:
    """Share counts and growth fields are not money and are never converted."""
    return ~tag.endswith("_shares_os") & ~tag.startswith("growth_")


def to_usd(std: DataFrame, rates: DataFrame) -> DataFrame:
    """Convert each non-USD row with the as-of rate of its period end.

    A row without a rate **stays in its native currency** (the ranking queries
    drop such rows instead). Converted rows are relabelled ``USD``.
    """
    needs = F.col("currency").isNotNull() & (F.col("currency") != "USD") & F.col("period_ending").isNotNull()
    rated = with_asof_rate(std, rates, "currency", "period_ending", "_fx", how="left")
    hit = needs & F.col("_fx").isNotNull()
    return (rated.withColumn("val", F.when(hit & is_monetary(F.col("tag")), F.col("val") * F.col("_fx"))
                             .otherwise(F.col("val")))
                 .withColumn("currency", F.when(hit, F.lit("USD")).otherwise(F.col("currency")))
                 .drop("_fx").select(*std.columns))


def growth(rows: DataFrame, offset: int, keys: Sequence[str] = ("cik", "statement")) -> DataFrame:
    """Period-over-period (offset 1) or year-over-year on quarters (offset 4) growth.

    The lag is *positional over periods*: periods are numbered per company and
    statement, and a line item at period i is compared with the same item at
    period i - offset, even when the item is missing in between. A RANGE frame of
    exactly ``offset`` index steps reads that row, so there is no self-join: one
    shuffle by (company, statement, line item), each window holding one line item's
    periods. Output: one row per (keys, tag, period) where the prior value exists
    and is not 0.
    """
    keys = list(keys)
    idx = period_index(rows, keys, "period_ending", ascending=True, name="_i")
    r = rows.join(idx, [*keys, "period_ending"], "inner")
    w = Window.partitionBy(*keys, "tag").orderBy("_i").rangeBetween(-offset, -offset)
    r = r.withColumn("_pv", F.max("val").over(w))
    g = growth_expr("val", "_pv")
    return (r.where(g.isNotNull())
             .select(*keys, "tag", "period_ending", "fiscal_year", "fiscal_period", g.alias("growth")))


# Growth offsets (periods back) of each kind of rows, by transform.
VIEW_OFFSETS = {"FY": {"% YoY": 1, "% PoP": 1}, "Q": {"% YoY": 4, "% PoP": 1}, "TTM": {"% YoY": 4, "% PoP": 1}}


def statement_views(std: DataFrame, rates: DataFrame | None, statement: str, limit: int = 10) -> DataFrame:
    """(period, transform, cik, tag, period_ending, value, period_rank): rows and growth of a statement in every view.

    One pass for all of them: a quarter is exploded into itself and the twelve months that it ends, one window per line
    item holds the values one and four periods back, and each view keeps its newest ``limit`` periods per company.
    Periods are counted from one short array a company and kind, so the rows are read twice in either step and written
    before it. Values are in USD where a rate exists.
    """
    s = std.where((F.col("statement") == statement) & F.col("frequency").isin("annual", "quarterly") & F.col("period_ending").isNotNull())
    if rates is not None:
        s = with_asof_rate(s, rates, "currency", "period_ending", "_fx", how="left")
        hit = (F.col("currency") != "USD") & F.col("_fx").isNotNull() & is_monetary(F.col("tag"))
        s = s.withColumn("_factor", F.when(hit, F.col("_fx")))
    else:
        s = s.withColumn("_factor", F.lit(None).cast("double"))
    s = with_ttm(s.select("cik", "statement", "tag", "frequency", "period_ending", "val", "_factor"))
    kinds = F.when(F.col("frequency") == "annual", F.array(F.struct(F.lit("FY").alias("period"), F.col("val").alias("v")))).otherwise(
        F.array(F.struct(F.lit("Q").alias("period"), F.col("val").alias("v")), F.struct(F.lit("TTM").alias("period"), F.col("ttm").alias("v"))))
    s = s.select("cik", "tag", "period_ending", "_factor", F.explode(kinds).alias("k")).select("cik", "tag", "period_ending", "_factor", "k.period", "k.v")
    s = s.where((F.col("period") != "TTM") | F.col("v").isNotNull())
    s = written(s, "views")
    periods = lambda found: F.array_sort(F.collect_set(F.when(found, F.col("period_ending"))))
    place = lambda every: F.array_position(every, F.col("period_ending"))
    s = s.join(s.groupBy("cik", "period").agg(periods(F.lit(True)).alias("_all")), ["cik", "period"]).withColumn("_i", place("_all"))
    w = Window.partitionBy("cik", "tag", "period").orderBy("_i")
    s = s.withColumn("_b1", F.max("v").over(w.rangeBetween(-1, -1))).withColumn("_b4", F.max("v").over(w.rangeBetween(-4, -4)))
    back = {1: F.col("_b1"), 4: F.col("_b4")}
    values = {"None": F.coalesce(F.col("v") * F.col("_factor"), F.col("v"))}
    for transform in ("% YoY", "% PoP"):
        values[transform] = F.coalesce(*[F.when(F.col("period") == p, growth_expr("v", back[o[transform]])) for p, o in VIEW_OFFSETS.items()])
    s = written(s.select("cik", "tag", "period", "period_ending", *[v.alias(t) for t, v in values.items()]), "views")
    shown = {t: F.lit(True) if t == "None" else F.col(t).isNotNull() for t in values}
    every = s.groupBy("cik", "period").agg(*[periods(shown[t]).alias(f"_all {t}") for t in values])
    rank = lambda t: (F.size(f"_all {t}") - place(f"_all {t}") + 1).cast("int")
    views = F.array(*[F.when(shown[t], F.struct(F.lit(t).alias("transform"), F.col(t).alias("value"), rank(t).alias("period_rank"))) for t in values])
    views = F.filter(views, lambda x: (x["period_rank"] <= limit) if limit else x.isNotNull())
    s = s.join(every, ["cik", "period"]).select("cik", "tag", "period", "period_ending", F.explode(views).alias("x"))
    return s.select("period", "x.transform", "cik", "tag", "period_ending", "x.value", "x.period_rank")


def drop_imputed(rows: DataFrame, keys: Sequence[str] = ("cik", "tag")) -> DataFrame:
    """Remove line items whose every value is null or 0 over the given rows
    (one window pass; the rows are read once)."""
    keys = list(keys)
    m = F.max(F.abs(F.coalesce(F.col("val"), F.lit(0.0)))).over(Window.partitionBy(*keys))
    return rows.withColumn("_m", m).where(F.col("_m") > 0).drop("_m")


def statement_transposed(std: DataFrame, statement: str, frequency: str = "annual", limit: int = 10) -> DataFrame:
    """Line items as rows, the newest ``limit`` periods as columns p1..pN (p1 = newest).

    Imputed line items (all null or 0 over those periods) are dropped after the
    pivot — the same test on the pivoted row — so the data is aggregated once.
    The pivot values are explicit, so Spark plans a single aggregation.
    """
    s = std.where((F.col("statement") == statement) & (F.col("frequency") == frequency))
    s = first_n_periods(s, "cik", "period_ending", limit, newest_first=True, name="period_rank")
    ranks = list(range(1, limit + 1))
    p = s.groupBy("cik", "tag").pivot("period_rank", ranks).agg(F.max("val"))
    live = F.greatest(*[F.abs(F.coalesce(F.col(str(k)), F.lit(0.0))) for k in ranks]) > 0
    return p.where(live).select("cik", "tag", humanize("tag").alias("line_item"),
                                *[F.col(str(k)).alias(f"p{k}") for k in ranks])


def statement_periods(std: DataFrame, statement: str, frequency: str = "annual", limit: int = 10) -> DataFrame:
    """Column headers of the transposed form: (cik, period_rank, label ``"<fp> <date>"``)."""
    s = std.where((F.col("statement") == statement) & (F.col("frequency") == frequency))
    s = first_n_periods(s, "cik", "period_ending", limit, newest_first=True, name="period_rank")
    return (s.groupBy("cik", "period_rank", "period_ending").agg(F.max("fiscal_period").alias("fiscal_period"))
             .select("cik", "period_rank", period_label("fiscal_period", "period_ending").alias("label")))


def statement_wide(std: DataFrame, statement: str, tags: Sequence[str], frequency: str = "annual",
                   limit: int = 10) -> DataFrame:
    """One row per period (oldest first when sorted), one column per line item.

    Columns of a company's imputed items are null (a single company's frame drops
    them); fiscal_year is shown as ``FY2020``.
    """
    s = std.where((F.col("statement") == statement) & (F.col("frequency") == frequency))
    s = first_n_periods(s, "cik", "period_ending", limit, newest_first=True, name="period_rank")
    s = drop_imputed(s)
    tags = list(tags)
    p = (s.groupBy("cik", "period_ending")
          .agg(F.max("fiscal_year").alias("fiscal_year"), F.max("fiscal_period").alias("fiscal_period"),
               *[F.max(F.when(F.col("tag") == t, F.col("val"))).alias(t) for t in tags]))
    return p.select("cik", F.date_format("period_ending", "yyyy-MM-dd").alias("period_ending"),
                    fiscal_year_label("fiscal_year").alias("fiscal_year"), "fiscal_period", *tags)
