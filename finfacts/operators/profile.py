"""Company profiles over canonical registrant groups (M8, L12, 7.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.functions.ids import sic4_text
from finfacts.operators.components import connected_components
from finfacts.operators.latest import latest_by


def canonical_ciks(ciks: DataFrame, multi_cik: DataFrame) -> DataFrame:
    """(cik, primary_cik): identity, except that registrants tied by tickers share one primary cik.

    Tickers and ciks are the nodes of a graph; all ciks of a connected component belong together, also those that no
    single ticker names together, and the one of best priority (then the smallest) stands for them.
    """
    pairs = multi_cik.where(F.col("ticker").isNotNull() & F.col("cik").isNotNull())
    part = connected_components(pairs.select(F.concat(F.lit("c"), "cik").alias("a"), F.concat(F.lit("t"), "ticker").alias("b")))
    part = part.where(F.col("node").startswith("c")).select(F.expr("substr(node, 2)").alias("cik"), "component")
    best = part.join(pairs.groupBy("cik").agg(F.min("priority").alias("priority")), "cik").groupBy("component").agg(
        F.min(F.struct(F.coalesce("priority", F.lit(2147483647)).alias("priority"), "cik"))["cik"].alias("_primary"))
    m = part.join(best, "component").select("cik", "_primary")
    allc = ciks.select("cik").union(multi_cik.select("cik")).distinct()
    return allc.join(m, "cik", "left").select("cik", F.coalesce("_primary", "cik").alias("primary_cik"))


def company_profiles(canonical: DataFrame, companies: DataFrame, tickers: DataFrame, dei: DataFrame,
                     std: DataFrame, submissions: DataFrame | None = None,
                     locations: DataFrame | None = None) -> DataFrame:
    """One profile per primary cik.

    dei: (cik, tag, val, val_text, end, filed, id) DEI rows; per tag the latest over
    the group by (end, filed, id) — SIC code and description, state of
    incorporation, fiscal-year end. submissions: optional (cik, exchanges) of the
    primary cik, order kept, duplicates dropped. locations: optional (code, name,
    is_us_state) to name the state of incorporation.
    """
    grp = canonical.select("cik", "primary_cik")
    related = grp.groupBy("primary_cik").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("cik") != F.col("primary_cik"), F.col("cik")))), ",")
        .alias("related_ciks"))
    t = tickers.join(grp, "cik", "inner").select(
        "primary_cik", F.struct((~F.col("is_primary")).alias("np"), F.length("ticker").alias("len"),
                                F.col("ticker").alias("ticker"), F.col("is_primary").alias("p")).alias("_t"))
    tk = t.groupBy("primary_cik").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    first_primary = F.filter("_ts", lambda x: x["p"])
    primary_ticker = F.coalesce(F.try_element_at(first_primary, F.lit(1))["ticker"], F.try_element_at("_ts", F.lit(1))["ticker"])
    tk = tk.select("primary_cik", primary_ticker.alias("primary_ticker"), "_ts")
    tk = tk.select("primary_cik", "primary_ticker",
                   F.array_join(F.transform(F.filter("_ts", lambda x: x["ticker"] != F.col("primary_ticker")),
                                            lambda x: x["ticker"]), ",").alias("secondary_tickers"))
    # One latest-per-(group, tag) aggregation for every DEI attribute, then a pivot.
    d = dei.join(grp, "cik", "inner").where(
        ((F.col("tag") == "EntitySicCode") & F.col("val").isNotNull())
        | (F.col("tag").isin("EntitySicDescription", "EntityStateOfIncorporation", "EntityFiscalYearEnd")
           & F.col("val_text").isNotNull()))
    latest = latest_by(d, ["primary_cik", "tag"], ["end", "filed", "id"],
                       cols=["primary_cik", "tag", "end", "filed", "id", "val", "val_text"])

    def pick(tag: str, col: str):
        return F.max(F.when(F.col("tag") == tag, F.col(col)))
    dei_wide = latest.groupBy("primary_cik").agg(
        sic4_text(F.floor(pick("EntitySicCode", "val")).cast("int")).alias("sic"),
        pick("EntitySicDescription", "val_text").alias("sic_name"),
        pick("EntityStateOfIncorporation", "val_text").alias("state_of_incorporation"),
        pick("EntityFiscalYearEnd", "val_text").alias("fiscal_year_end"))
    periods = (std.select("cik", "period_ending").join(grp, "cik", "inner")
               .groupBy("primary_cik").agg(F.min("period_ending").alias("first_period"),
                                           F.max("period_ending").alias("latest_period")))
    names = companies.select(F.col("cik").alias("primary_cik"), "entity_name")
    base = grp.select("primary_cik").distinct()
    out = (base.join(names, "primary_cik", "left").join(tk, "primary_cik", "left").join(related, "primary_cik", "left")
           .join(dei_wide, "primary_cik", "left").join(periods, "primary_cik", "left"))
    if submissions is not None:
        ex = submissions.select(F.col("cik").alias("primary_cik"),
                                F.array_join(F.array_distinct("exchanges"), ",").alias("exchanges"))
        out = out.join(ex, "primary_cik", "left")
    else:
        out = out.withColumn("exchanges", F.lit(None).cast("string"))
    if locations is not None:
        from finfacts.operators.sets import decode_location
        out = decode_location(out, "state_of_incorporation", locations, "_inc") \
            .withColumnRenamed("_inc_name", "state_of_incorporation_name").drop("_inc_state", "_inc_country")
    else:
        out = out.withColumn("state_of_incorporation_name", F.lit(None).cast("string"))
    return out.select(F.col("primary_cik").alias("cik"), F.col("entity_name").alias("name"), "primary_ticker",
                      "secondary_tickers", "related_ciks", "exchanges", "state_of_incorporation",
                      "state_of_incorporation_name", "sic", "sic_name", "fiscal_year_end", "first_period",
                      "latest_period")
