import datetime as dt

from pyspark.sql import functions as F

from finfacts.functions import ids, numeric, text


def _one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).collect()[0]["r"]


def test_normalize_cik(spark):
    f = ids.normalize_cik("x")
    assert _one(spark, f, " 320193 ") == "0000320193"
    assert _one(spark, f, "0000000000") == "0000000000"
    assert _one(spark, f, "0") == "0000000000"
    assert _one(spark, f, "12345678901") == "12345678901"   # longer than 10 digits is kept, not cut
    assert _one(spark, f, "12a") is None
    assert _one(spark, f, "") is None
    assert _one(spark, f, None) is None


def test_ticker_and_dates(spark):
    assert _one(spark, ids.normalize_ticker("x"), "brk.b") == "BRK-B"
    d = ids.strict_date("x")
    assert _one(spark, d, "2020-02-29") == dt.date(2020, 2, 29)
    assert _one(spark, d, "2021-02-29") is None
    assert _one(spark, d, "2020-01-01T00:00:00") is None and _one(spark, d, " 2020-01-01") is None and _one(spark, d, "2020-01-01\n") is None
    assert _one(spark, d, "01/02/2020") is None


def test_number_coercion(spark):
    i = ids.to_int_or_null("x")
    assert _one(spark, i, "2001") == 2001
    assert _one(spark, i, " +7 ") == 7
    assert _one(spark, i, "bad") is None
    assert _one(spark, i, "20.5") is None
    assert _one(spark, ids.sic4_text(F.col("x")), 100, "x int") == "0100"
    assert _one(spark, ids.sic4(F.col("x")), 2834.9, "x double") == 2834


def test_growth_and_rounding(spark):
    df = spark.createDataFrame([(110.0, 100.0), (5.0, 0.0), (5.0, None), (0.99999, 1.0)], "v double, p double")
    out = [r["g"] for r in df.select(numeric.growth("v", "p").alias("g")).collect()]
    assert out[0] == 0.1 and out[1] is None and out[2] is None
    assert str(out[3]) == "0.0"   # -0.00001 rounds to +0.0, not -0.0
    z = spark.createDataFrame([(-0.001,)], "x double").select(numeric.round_to("x", 2).alias("r")).collect()[0]["r"]
    assert str(z) == "0.0"   # signed zero folded


def test_humanize_and_sources(spark):
    assert _one(spark, text.humanize("x"), "purchase_of_ppe") == "Purchase Of PPE"
    assert _one(spark, text.humanize("x"), "sga_expense") == "SG&A Expense"
    assert _one(spark, text.source_label("x"), "derived:  net_income (Q4)") == "derived from prior period Net Income"
    assert _one(spark, text.source_label("x"), "derived:") == "derived from prior period"
    assert _one(spark, text.source_label("x"), "us-gaap:Revenues (fallback)") == \
        "us-gaap:Revenues (tag sourced from filing vintage other than original)"
    assert _one(spark, text.source_group_key("x"), "Derived: Net_Income (Q1)") == "derived:net_income"
    assert _one(spark, text.source_group_key("x"), "us-gaap:A   B") == "us-gaap:A B"


def test_batch_search_matches_single_search(spark):
    from finfacts.operators import resolve as rs
    ents = spark.createDataFrame([("1", "ACME 100% Corp"), ("2", "Acme Holdings"), ("3", "AXME Co"), ("4", "Beta")],
                                 "cik string, entity_name string")
    got = sorted(map(tuple, rs.search_entities_batch(ents, ["ACME", "A_ME", "100%", "zzz"], 2).collect()))
    want = sorted((k, r["cik"], r["entity_name"]) for k in ["ACME", "A_ME", "100%"]
                  for r in rs.search_entities(ents, k, 2).collect())
    assert got == want and ("A_ME", "3", "AXME Co") in got    # '_' stays a wildcard
