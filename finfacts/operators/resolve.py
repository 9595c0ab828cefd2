"""Bulk symbol / company resolution, company lists and name search (M3-M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finfacts.functions.ids import normalize_ticker
from finfacts.session import written

#: Names of one character sequence that a keyword meets in one place.
POSTINGS_PART = 50_000


def _processed(processed: DataFrame) -> DataFrame:
    flags = F.col("has_balance") & F.col("has_income") & F.col("has_cash_flow")
    return processed.where(flags).select("cik")


def companies_with_financials(companies: DataFrame, tickers: DataFrame, processed: DataFrame) -> DataFrame:
    """(cik, ticker = min ticker, name = min name) of processed companies that have a ticker."""
    j = (companies.join(tickers.select("cik", "ticker"), "cik", "inner")
                  .join(_processed(processed), "cik", "left_semi"))
    return j.groupBy("cik").agg(F.min("ticker").alias("ticker"), F.min("entity_name").alias("name"))


def company_choices(primary_tickers: DataFrame, companies: DataFrame, processed: DataFrame) -> DataFrame:
    """(label, value, description ``ticker | cik``, rank) per primary ticker of a processed company, by rank (null
    last), then ticker."""
    j = (primary_tickers.join(companies.select("cik", "entity_name"), "cik", "inner")
                        .join(_processed(processed), "cik", "left_semi"))
    return j.select(F.col("entity_name").alias("label"), F.col("ticker").alias("value"), "cik",
                    F.concat_ws(" | ", F.col("ticker"), F.col("cik")).alias("description"), "rank") \
        .orderBy(F.col("rank").asc_nulls_last(), "value", "cik")


def resolve_symbols(symbols: DataFrame, multi_cik: DataFrame, tickers: DataFrame, funds: DataFrame,
                    symbol: str = "symbol") -> DataFrame:
    """symbol -> ciks: the override list (by priority), else the listed ticker, else a
    fund share class; the first tier with a match wins.

    Tiers 2 and 3 take the smallest cik when a symbol maps to several. The override
    list is grouped per ticker (a handful of registrants each).
    """
    s = symbols.select(F.col(symbol).alias("symbol")).distinct().withColumn("_sym", normalize_ticker("symbol"))
    multi = (multi_cik.groupBy(F.col("ticker").alias("_sym"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "cik"))),
                                           lambda x: x["cik"]), ",").alias("_m")))
    tick = tickers.groupBy(F.col("ticker").alias("_sym")).agg(F.min("cik").alias("_t"))
    fund = funds.groupBy(F.col("symbol").alias("_sym")).agg(F.min("cik").alias("_f"))
    j = s.join(multi, "_sym", "left").join(tick, "_sym", "left").join(fund, "_sym", "left")
    tier = F.when(F.col("_m").isNotNull(), 1).when(F.col("_t").isNotNull(), 2).when(F.col("_f").isNotNull(), 3)
    return j.select("symbol", tier.alias("tier"), F.coalesce("_m", "_t", "_f").alias("ciks"))


def resolve_ciks(ciks: DataFrame, tickers: DataFrame) -> DataFrame:
    """cik -> smallest ticker ('' when the company has none)."""
    t = tickers.groupBy("cik").agg(F.min("ticker").alias("ticker"))
    return (ciks.select("cik").distinct().join(t, "cik", "left")
                .select("cik", F.coalesce("ticker", F.lit("")).alias("ticker")))


def like_pattern(keyword: str) -> str:
    """``%kw%`` with ``%`` escaped; ``_`` stays a wildcard (the reference's behaviour)."""
    return "%" + keyword.replace("\\", "\\\\").replace("%", "\\%") + "%"


def search_entities(entities: DataFrame, keyword: str, limit: int | None = None) -> DataFrame:
    """Case-sensitive LIKE search on names, in the order of names; with ``limit`` the first so many (a top-k)."""
    m = entities.where(F.col("entity_name").like(like_pattern(keyword))).orderBy(F.col("entity_name").asc(), F.col("cik").asc())
    if limit is not None:
        m = m.limit(int(limit))
    return m.select("cik", "entity_name")


def _grams(text, size: int):
    """All sequences of ``size`` characters."""
    n = F.length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def search_keywords(entities: DataFrame, keywords: DataFrame, keyword: str = "keyword", limit: int | None = None) -> DataFrame:
    """A table of keywords at once: (keyword, cik, entity_name); with ``limit`` the first so many per keyword by name.

    The LIKE rule of ``search_entities``. Names are posted under their sequences of three characters, and a keyword asks
    for the rarest one that it must contain (between wildcards); only names found there are compared. A keyword without
    three characters in a row asks for two or one, and one of wildcards alone for every name. Null keywords find nothing.
    A sequence of many names is dealt out in parts of about ``POSTINGS_PART`` names, each compared with all its keywords.
    """
    kws = keywords.select(F.col(keyword).alias("keyword")).where(F.col("keyword").isNotNull()).distinct()
    runs = F.split("keyword", "_")
    needs = F.array_distinct(F.flatten(F.transform(runs, lambda r: _grams(r, 3))))
    for size in (2, 1):
        needs = F.when(F.size(needs) > 0, needs).otherwise(F.array_distinct(F.flatten(F.transform(runs, lambda r, s=size: _grams(r, s)))))
    needs = F.when(F.size(needs) > 0, needs).otherwise(F.array(F.lit("")))
    asked = kws.select("keyword", F.explode(needs).alias("gram"))
    names = entities.select("cik", "entity_name").where(F.col("entity_name").isNotNull())
    # Postings of the lengths that occur in a keyword only: shorter ones join nothing otherwise.
    text = F.col("entity_name")
    posted = names.select("cik", "entity_name", F.explode(F.array_distinct(F.concat(_grams(text, 3), _grams(text, 2), _grams(text, 1), F.array(F.lit(""))))).alias("gram"))
    count = posted.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rarest = asked.join(count, "gram", "left").groupBy("keyword").agg(F.min(F.struct(n.alias("n"), "gram")).alias("_g"))
    rarest = rarest.select("keyword", "_g.gram", F.greatest(F.lit(1), F.ceil(F.col("_g.n") / POSTINGS_PART)).alias("_parts"))
    rarest = written(rarest, "rarest")
    posted = posted.join(rarest.select("gram", "_parts").distinct(), "gram").withColumn("_part", F.pmod(F.xxhash64("cik", "entity_name"), F.col("_parts"))).drop("_parts")
    rarest = rarest.select("keyword", "gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    # "%" and the escape character stand for themselves, "_" is any character.
    pattern = F.replace(F.replace("keyword", F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%"))
    hits = posted.join(rarest, ["gram", "_part"]).where(F.like(text, F.concat(F.lit("%"), pattern, F.lit("%"))))
    if limit is not None:
        w = Window.partitionBy("keyword").orderBy(F.col("entity_name").asc(), F.col("cik").asc())
        hits = hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= int(limit))
    return hits.select("keyword", "cik", "entity_name")


def search_entities_batch(entities: DataFrame, keywords: list[str], limit: int | None = None) -> DataFrame:
    """Many keywords in one scan: (keyword, cik, entity_name); with ``limit`` the first so many per keyword by name.

    No join: the keywords (user input, a short list) are literals in one expression
    that lists, per entity row, the keywords its name matches (same LIKE rule as
    ``search_entities``); the per-keyword top-``limit`` runs as a group limit before
    the shuffle.
    """
    kws = sorted(set(keywords))
    if not kws:
        return entities.sparkSession.createDataFrame([], "keyword string, cik string, entity_name string")
    pats = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(like_pattern(k)).alias("p")) for k in kws])
    hits = F.filter(pats, lambda x: F.like(F.col("entity_name"), x["p"]))
    j = entities.select("cik", "entity_name", F.explode(F.transform(hits, lambda x: x["k"])).alias("keyword"))
    if limit is None:
        return j.select("keyword", "cik", "entity_name")
    w = Window.partitionBy("keyword").orderBy(F.col("entity_name").asc(), F.col("cik").asc())
    return j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= int(limit)).select(
        "keyword", "cik", "entity_name")
