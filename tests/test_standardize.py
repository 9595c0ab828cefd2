"""Standardization (our design), presentation, registrant merge, payload helpers, locations."""
import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from finfacts.functions import payload
from finfacts.operators import sets
from finfacts.operators import standardize as sd

D = dt.date
FACT = "cik string, namespace string, tag string, unit string, start date, end date, val double, fy int, fp string, filed date"


def test_standardize_priority_period_class_and_q4(spark):
    rules = spark.createDataFrame([
        ("industrial", "income_statement", "total_revenue", 1, "us-gaap", "Revenues", "duration"),
        ("industrial", "income_statement", "total_revenue", 2, "us-gaap", "SalesRevenueNet", "duration"),
        ("industrial", "balance_sheet", "total_assets", 1, "us-gaap", "Assets", "instant")], sd.RULE_SCHEMA)
    f = spark.createDataFrame([
        ("1", "us-gaap", "Revenues", "USD", D(2020, 1, 1), D(2020, 12, 31), 100.0, 2020, "FY", D(2021, 2, 1)),
        ("1", "us-gaap", "SalesRevenueNet", "USD", D(2020, 1, 1), D(2020, 12, 31), 999.0, 2020, "FY", D(2021, 3, 1)),
        ("1", "us-gaap", "Revenues", "USD", D(2020, 1, 1), D(2020, 3, 31), 20.0, 2020, "Q1", D(2020, 5, 1)),
        ("1", "us-gaap", "Revenues", "USD", D(2020, 4, 1), D(2020, 6, 30), 25.0, 2020, "Q2", D(2020, 8, 1)),
        ("1", "us-gaap", "Revenues", "USD", D(2020, 4, 1), D(2020, 6, 30), 26.0, 2020, "Q2", D(2021, 8, 1)),  # restated
        ("1", "us-gaap", "Revenues", "USD", D(2020, 7, 1), D(2020, 9, 30), 30.0, 2020, "Q3", D(2020, 11, 1)),
        ("1", "us-gaap", "Revenues", "USD", D(2020, 1, 1), D(2020, 9, 30), 75.0, 2020, "Q3", D(2020, 11, 1)),  # 9 months
        ("1", "us-gaap", "Assets", "USD", None, D(2020, 12, 31), 500.0, 2020, "FY", D(2021, 2, 1)),
        ("1", "us-gaap", "Assets", "USD", None, D(2020, 9, 30), 450.0, 2020, "Q3", D(2020, 11, 1))], FACT)
    rows = {(r["statement"], r["tag"], r["frequency"], r["fiscal_period"], r["period_ending"]): r
            for r in sd.standardize(f, rules).collect()}
    fy = rows[("income_statement", "total_revenue", "annual", "FY", D(2020, 12, 31))]
    assert fy["val"] == 100.0 and fy["source"] == "us-gaap:Revenues" and fy["currency"] == "USD"
    assert rows[("income_statement", "total_revenue", "quarterly", "Q2", D(2020, 6, 30))]["val"] == 26.0
    q4 = rows[("income_statement", "total_revenue", "quarterly", "Q4", D(2020, 12, 31))]
    assert q4["val"] == 100.0 - (20.0 + 26.0 + 30.0) and q4["source"] == "derived: total_revenue (Q4)"
    assert rows[("balance_sheet", "total_assets", "annual", "FY", D(2020, 12, 31))]["val"] == 500.0
    assert rows[("balance_sheet", "total_assets", "quarterly", "Q3", D(2020, 9, 30))]["val"] == 450.0
    assert not any(k[3] == "Q3" and k[1] == "total_revenue" and r["val"] == 75.0 for k, r in rows.items())


def test_ttm_and_presentation(spark):
    std = spark.createDataFrame([("1", "income_statement", D(2020, 3 * q, 28), 2020, f"Q{q}", "quarterly", "rev", float(q),
                                  "USD", "industrial") for q in range(1, 5)] +
                                [("1", "income_statement", D(2021, 3, 28), 2021, "Q1", "quarterly", "rev", 10.0, "USD",
                                  "industrial")],
                                "cik string, statement string, period_ending date, fiscal_year int, fiscal_period string, "
                                "frequency string, tag string, val double, currency string, company_type string")
    t = {r["period_ending"]: r["val"] for r in sd.ttm(std).collect()}
    assert t == {D(2020, 12, 28): 10.0, D(2021, 3, 28): 19.0}
    pres = spark.createDataFrame([("industrial", "income_statement", "rev", "Rev v1", "", None, 1, "+", "", "monetary", 1),
                                  ("industrial", "income_statement", "rev", "Revenue", "", None, 1, "+", "", "monetary", 2)],
                                 "company_type string, statement string, tag string, label string, description string, "
                                 "parent string, sequence int, factor string, balance string, unit string, load_seq int")
    dim = sd.presentation_dim(pres)
    assert dim.collect()[0]["label"] == "Revenue"
    out = sd.standardized_statements(std.union(std.limit(1).withColumn("tag", F.lit("other"))
                                               .withColumn("frequency", F.lit("quarterly"))), dim, None, "quarterly")
    labels = {r["tag"]: (r["label"], r["factor"], r["unit"]) for r in out.collect()}
    assert labels["rev"] == ("Revenue", "+", "monetary") and labels["other"] == ("other", "+", "monetary")


def test_merge_registrants_priority(spark):
    std = spark.createDataFrame([("a", "is", "rev", D(2020, 12, 31), 2020, "FY", "annual", 1.0),
                                 ("b", "is", "rev", D(2020, 12, 31), 2020, "FY", "annual", 2.0),
                                 ("b", "is", "ni", D(2020, 12, 31), 2020, "FY", "annual", 3.0)],
                                "cik string, statement string, tag string, period_ending date, fiscal_year int, "
                                "fiscal_period string, frequency string, val double")
    canon = spark.createDataFrame([("a", "b"), ("b", "b")], "cik string, primary_cik string")
    prio = spark.createDataFrame([("a", 0), ("b", 1)], "cik string, priority int")
    got = {(r["tag"]): (r["cik"], r["source_cik"], r["val"]) for r in sd.merge_registrants(std, canon, prio).collect()}
    assert got == {"rev": ("b", "a", 1.0), "ni": ("b", "b", 3.0)}


def test_payload_helpers(spark):
    df = spark.createDataFrame([('{"b":1,"a":[1,2]}',), ('{ "a": [1, 2], "b": 1 }',), ("nope",)], "p string")
    h = [r["h"] for r in df.select(payload.canonical_json_sha256(F.col("p")).alias("h")).collect()]
    assert h[0] == h[1] and h[0] is not None and h[2] is None
    z = df.select(payload.gzip_canonical_json(F.col("p")).alias("z"))
    back = [r["t"] for r in z.select(payload.gunzip_text(F.col("z")).alias("t")).collect()]
    assert back[0] == back[1] == '{"a":[1,2],"b":1}' and back[2] is None
    assert json.loads(gzip.decompress(bytes(z.collect()[0]["z"]))) == {"a": [1, 2], "b": 1}


def test_location_decode(spark):
    df = spark.createDataFrame([("1", "DE"), ("2", "A6"), ("3", "ZZ"), ("4", None)], "cik string, st string")
    extra = spark.createDataFrame([("ZZ", "Testland")], "code string, name string")
    out = {r["cik"]: (r["inc_name"], r["inc_state"], r["inc_country"])
           for r in sets.decode_location(df, "st", sets.location_dim(spark, extra), "inc").collect()}
    assert out == {"1": ("Delaware", "Delaware", None), "2": ("Ontario, Canada", None, "Ontario, Canada"),
                   "3": ("Testland", None, "Testland"), "4": (None, None, None)}


def test_profile_dei_fields_and_exchanges(spark):
    from finfacts.operators import profile as pf
    canon = spark.createDataFrame([("1", "1"), ("2", "1")], "cik string, primary_cik string")
    comps = spark.createDataFrame([("1", "One")], "cik string, entity_name string")
    ticks = spark.createDataFrame([("1", "ONE", True), ("2", "ONE-B", False)], "cik string, ticker string, is_primary boolean")
    dei = spark.createDataFrame([
        ("1", "EntityStateOfIncorporation", None, "DE", D(2020, 1, 1), D(2020, 1, 1), 1),
        ("2", "EntityStateOfIncorporation", None, "A6", D(2021, 1, 1), D(2021, 1, 1), 2),
        ("1", "EntityFiscalYearEnd", None, "1231", D(2020, 1, 1), D(2020, 1, 1), 3),
        ("1", "EntitySicCode", 7372.0, None, D(2020, 1, 1), D(2020, 1, 1), 4)],
        "cik string, tag string, val double, val_text string, end date, filed date, id int")
    std = spark.createDataFrame([("2", D(2019, 12, 31))], "cik string, period_ending date")
    subs = spark.createDataFrame([("1", ["NYSE", "Nasdaq", "NYSE"])], "cik string, exchanges array<string>")
    r = pf.company_profiles(canon, comps, ticks, dei, std, subs, sets.location_dim(spark)).collect()[0]
    assert (r["cik"], r["name"], r["primary_ticker"], r["secondary_tickers"], r["related_ciks"]) == \
        ("1", "One", "ONE", "ONE-B", "2")
    assert r["state_of_incorporation"] == "A6" and r["state_of_incorporation_name"] == "Ontario, Canada"
    assert r["fiscal_year_end"] == "1231" and r["sic"] == "7372" and r["exchanges"] == "NYSE,Nasdaq"
    assert r["first_period"] == r["latest_period"] == D(2019, 12, 31)
