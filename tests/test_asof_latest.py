"""As-of join vs a brute-force range join; latest-row picks vs ROW_NUMBER."""
import datetime as dt

from pyspark.sql import functions as F

from finfacts.operators.asof import with_asof_rate
from finfacts.operators.latest import latest_by, period_index

D = dt.date


def test_asof_matches_range_join(spark):
    rates = spark.createDataFrame([
        (D(2020, 1, 2), "EUR", "USD", 1.1), (D(2020, 1, 5), "EUR", "USD", 1.2),
        (D(2020, 1, 5), "EUR", "USD", 1.25),   # two quotes on one day: the larger wins
        (D(2020, 1, 3), "JPY", "USD", 0.009), (D(2020, 1, 3), "EUR", "GBP", 9.0)],
        "rate_date date, from_currency string, to_currency string, rate double")
    facts = spark.createDataFrame([
        (1, "EUR", D(2020, 1, 1)), (2, "EUR", D(2020, 1, 2)), (3, "EUR", D(2020, 1, 4)),
        (4, "EUR", D(2020, 1, 5)), (5, "EUR", D(2030, 1, 1)), (6, "JPY", D(2020, 1, 9)),
        (7, "XXX", D(2020, 1, 9)), (8, None, D(2020, 1, 9))], "id int, currency string, d date")
    got = {r["id"]: r["rate"] for r in with_asof_rate(facts, rates, "currency", "d").collect()}
    r = rates.where(F.col("to_currency") == "USD")
    brute = (facts.join(r, (facts.currency == r.from_currency) & (r.rate_date <= facts.d), "left")
             .groupBy("id").agg(F.max_by("rate", F.struct("rate_date", "rate")).alias("rate")))
    want = {row["id"]: row["rate"] for row in brute.collect()}
    assert got == want
    assert got[1] is None and got[3] == 1.1 and got[4] == 1.25 and got[5] == 1.25 and got[7] is None


def test_latest_by_ties_and_nulls(spark):
    df = spark.createDataFrame([
        ("a", D(2020, 12, 31), 2020, "FY", 1.0), ("a", D(2020, 12, 31), 2020, "Q4", 2.0),
        ("a", D(2019, 12, 31), 2019, "FY", 9.0), ("b", D(2020, 1, 1), 2020, "FY", None),
        ("b", D(2020, 1, 1), 2020, "FY", 3.0)], "cik string, period_ending date, fiscal_year int, fiscal_period string, val double")
    out = {r["cik"]: r for r in latest_by(df, ["cik"], ["period_ending", "fiscal_year", "fiscal_period", "val"]).collect()}
    assert out["a"]["fiscal_period"] == "Q4" and out["a"]["val"] == 2.0
    assert out["b"]["val"] == 3.0          # DESC NULLS LAST on the last tie-breaker


def test_period_index_counts_periods_not_values(spark):
    df = spark.createDataFrame([("a", "x", D(2020, 3, 31)), ("a", "y", D(2020, 6, 30)), ("a", "x", D(2020, 9, 30))],
                               "cik string, tag string, period_ending date")
    idx = {r["period_ending"]: r["i"] for r in period_index(df, "cik", "period_ending", name="i").collect()}
    assert idx == {D(2020, 3, 31): 1, D(2020, 6, 30): 2, D(2020, 9, 30): 3}
