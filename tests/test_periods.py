"""Fiscal years and quarters from year-to-date periods, on literal rows."""
import datetime as dt

import pytest

from finfacts.operators import standardize as sd

D = dt.date
FACT = "cik string, namespace string, tag string, unit string, start date, end date, val double, fp string, filed date"
RULES = [("industrial", "cash_flow", "ocf", 1, "us-gaap", "Ocf", "duration"), ("industrial", "income_statement", "rev", 1, "us-gaap", "Rev", "duration"),
         ("industrial", "balance_sheet", "assets", 1, "us-gaap", "Assets", "instant")]


def _run(spark, facts):
    rows = [(c, "us-gaap", tag, unit, s, e, v, fp, e + dt.timedelta(30)) for c, tag, unit, s, e, v, fp in facts]
    out = sd.standardize(spark.createDataFrame(rows, FACT), spark.createDataFrame(RULES, sd.RULE_SCHEMA)).collect()
    keys = [(r["cik"], r["tag"], r["currency"], r["period_ending"], r["frequency"]) for r in out]
    assert len(keys) == len(set(keys))
    return {(r["cik"], r["tag"], r["fiscal_year"], r["fiscal_period"]): (r["val"], r["period_ending"], r["source"].startswith("derived")) for r in out}


def _quarters(cik, tag, starts, vals, unit="USD"):
    """Reported first, second and third quarter."""
    return [(cik, tag, unit, s, e, v, f"Q{i}") for i, (s, e, v) in enumerate(zip(starts, [x - dt.timedelta(1) for x in starts[1:]], vals), 1)]


def test_quarters_belong_to_the_year_that_holds_them(spark):
    """A year to January: 500 in all and 100 a quarter leave 200, whatever the next year's quarters are."""
    this = [D(2023, 2, 1), D(2023, 5, 1), D(2023, 8, 1), D(2023, 11, 1)]
    nxt = [D(2024, 2, 1), D(2024, 5, 1), D(2024, 8, 1), D(2024, 11, 1)]
    facts = _quarters("1", "Rev", this, [100.0] * 3) + [("1", "Rev", "USD", D(2023, 2, 1), D(2024, 1, 31), 500.0, "FY")] + _quarters("1", "Rev", nxt, [300.0] * 3)
    got = _run(spark, facts)
    assert got[("1", "rev", 2024, "Q4")] == (200.0, D(2024, 1, 31), True)
    assert got[("1", "rev", 2024, "Q1")][:2] == (100.0, D(2023, 4, 30)) and got[("1", "rev", 2025, "Q1")][:2] == (300.0, D(2024, 4, 30))
    assert ("1", "rev", 2025, "Q4") not in got and len(got) == 8


@pytest.mark.parametrize("start,ends,year", [
    (D(2022, 1, 1), [D(2022, 3, 31), D(2022, 6, 30), D(2022, 9, 30), D(2022, 12, 31)], 2022),
    (D(2022, 7, 1), [D(2022, 9, 30), D(2022, 12, 31), D(2023, 3, 31), D(2023, 6, 30)], 2023),
    (D(2022, 2, 1), [D(2022, 4, 30), D(2022, 7, 31), D(2022, 10, 31), D(2023, 1, 31)], 2023),
    (D(2021, 1, 3), [D(2021, 4, 3), D(2021, 7, 3), D(2021, 10, 2), D(2022, 1, 1)], 2021),            # 52 weeks, to the first of January
    (D(2022, 1, 2), [D(2022, 4, 2), D(2022, 7, 2), D(2022, 10, 1), D(2023, 1, 7)], 2022),            # 53 weeks
])
def test_year_to_date_is_taken_apart(spark, start, ends, year):
    ytd = [10.1, 30.3, 60.6, 100.7]
    facts = [("1", "Ocf", "USD", start, e, v, fp) for e, v, fp in zip(ends, ytd, ("Q1", "Q2", "Q3", "FY"))]
    got = _run(spark, facts)
    assert {k[2:]: v for k, v in got.items()} == {
        (year, "Q1"): (10.1, ends[0], False), (year, "Q2"): (20.2, ends[1], True), (year, "Q3"): (30.3, ends[2], True),
        (year, "Q4"): (40.1, ends[3], True), (year, "FY"): (100.7, ends[3], False)}
    # Without the annual fact yet: the year that the series begins.
    open_year = {k[2:]: v for k, v in _run(spark, facts[:3]).items()}
    assert open_year == {(year, "Q1"): (10.1, ends[0], False), (year, "Q2"): (20.2, ends[1], True), (year, "Q3"): (30.3, ends[2], True)}


def test_what_is_not_told_is_not_derived(spark):
    y = [D(2022, 3, 31), D(2022, 6, 30), D(2022, 9, 30), D(2022, 12, 31)]
    s = D(2022, 1, 1)
    no_half = _run(spark, [("1", "Ocf", "USD", s, e, v, fp) for e, v, fp in ((y[0], 1.0, "Q1"), (y[2], 6.0, "Q3"), (y[3], 10.0, "FY"))])
    assert sorted(k[3] for k in no_half) == ["FY", "Q1", "Q4"] and no_half[("1", "ocf", 2022, "Q4")][0] == 4.0
    backward = _run(spark, [("1", "Ocf", "USD", s, y[3], 10.0, "FY"), ("1", "Ocf", "USD", D(2022, 10, 1), y[3], 4.0, "Q4"), ("1", "Ocf", "USD", s, y[1], 3.0, "Q2")])
    assert backward[("1", "ocf", 2022, "Q3")] == (3.0, y[2], True) and ("1", "ocf", 2022, "Q2") not in backward
    # Units aren't mixed, a sum over the last twelve months in a quarterly filing makes no fiscal year.
    mixed = _run(spark, [("1", "Ocf", "USD", s, y[0], 1.0, "Q1"), ("1", "Ocf", "EUR", s, y[1], 3.0, "Q2")])
    assert sorted(k[3] for k in mixed) == ["Q1"]
    trailing = _run(spark, [("1", "Rev", "USD", D(2021, 4, 1), y[0], 50.0, "Q1"), ("1", "Rev", "USD", s, y[0], 11.0, "Q1"), ("1", "Rev", "USD", s, y[3], 60.0, "FY")])
    assert trailing[("1", "rev", 2022, "Q1")][:2] == (11.0, y[0])
    # A half year that doesn't start the year (semi-annual filers) takes no part; nulls don't either.
    second_half = _run(spark, [("1", "Rev", "USD", D(2022, 7, 1), y[3], 5.0, "FY"), ("1", "Rev", "USD", s, y[3], 9.0, "FY"), ("1", "Rev", "USD", s, y[1], None, "Q2")])
    assert sorted(k[3] for k in second_half) == ["FY"]


def test_instants_take_their_quarter_from_the_year(spark):
    got = _run(spark, [("1", "Rev", "USD", D(2023, 2, 1), D(2024, 1, 31), 5.0, "FY"), ("1", "Assets", "USD", None, D(2023, 7, 31), 7.0, "Q2"),
                       ("1", "Assets", "USD", None, D(2023, 4, 30), 6.0, "Q2"), ("1", "Assets", "USD", None, D(2024, 1, 31), 8.0, "FY"),
                       ("2", "Assets", "USD", None, D(2023, 4, 30), 6.0, None)])
    assert got[("1", "assets", 2024, "Q2")][0] == 7.0 and got[("1", "assets", 2024, "Q1")][0] == 6.0 and got[("1", "assets", 2024, "FY")][0] == 8.0
    assert got[("2", "assets", 2023, "Q2")][0] == 6.0                   # no fiscal year known: the calendar's quarter
    assert sd.standardize(spark.createDataFrame([], FACT), spark.createDataFrame(RULES, sd.RULE_SCHEMA)).count() == 0
