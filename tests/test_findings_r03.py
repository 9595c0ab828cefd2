"""Findings of round 3: whole searches, schemas of many values, and tables that are read once."""

import json

import pytest
from conftest import SMALL

from finfacts.operators import resolve as rs
from finfacts.operators import standardize as sd
from finfacts.operators import statements as st
from finfacts.operators.joins import literal_table
from finfacts.plans import fixtures, q_company
from finfacts.plans.q_extra import FIXTURE_STD_RULES
from finfacts.sources import filings


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_tag_rules_have_no_bound_on_values(spark):
    key = "spark.sql.cteRecursionRowLimit"
    docs = [("cash_flow", json.dumps({"a": [{"xbrl_tags": [f"us-gaap:T{i}", {"namespace": "ifrs-full", "tag": "U"}, 5, None]}]})) for i in range(30)]
    docs += [("cash_flow", "no json"), ("cash_flow", None), (None, '{"xbrl_tags": [{"x": {"xbrl_tags": ["us-gaap:V"]}}]}')]
    before = spark.conf.get(key, None)
    spark.conf.set(key, "20")
    try:
        got = {tuple(r) for r in filings.statement_tag_rules(spark.createDataFrame(docs, "statement string, json string")).collect()}
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert got == {("cash_flow", "us-gaap", f"T{i}") for i in range(30)} | {("cash_flow", "ifrs-full", "U"), (None, "us-gaap", "V")}
    assert filings.statement_tag_rules(spark.createDataFrame([], "statement string, json string")).collect() == []


def test_name_search_returns_every_match_in_order(spark):
    names = [(f"{i:010d}", f"Customer#{i:09d}") for i in range(1200, -1, -1)] + [("x", "other"), ("y", None)]
    got = [r["entity_name"] for r in q_company.search_entities({"fx_companies": spark.createDataFrame(names, "cik string, entity_name string")}).collect()]
    assert got == [f"Customer#{i:09d}" for i in range(1201)]


def test_keywords_meet_names_in_bounded_parts(spark, monkeypatch):
    names = [(f"{i:04d}" if i % 9 else None, f"Name {i % 70:03d}") for i in range(300)] + [("n", None), ("e", "")]
    words = ["", "_", "Name", "00", "1", "e_0", "zzz", "9 ", None]
    entities = spark.createDataFrame(names, "cik string, entity_name string")
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    whole = rows_of(rs.search_keywords(entities, keywords))
    monkeypatch.setattr(rs, "POSTINGS_PART", 7)
    assert rows_of(rs.search_keywords(entities, keywords)) == whole
    want = sum(rs.search_entities(entities, w).count() for w in words if w is not None)
    assert len(whole) == want


def test_statement_rows_are_built_from_one_reading_of_the_sales(spark):
    cat = fixtures.FixtureCatalog(spark, SMALL)
    std = cat["fx_std"]
    plan = std._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.count("Relation [l_orderkey") == 1
    for name in [*cat.raw, *fixtures.closure(["fx_std"])]:
        (cat.raw[name] if name in cat.raw else cat.tables[name]).createOrReplaceTempView(name)
    by_sql = spark.sql(fixtures._BY_NAME["fx_std"][1])
    for name in [*cat.raw, *fixtures.closure(["fx_std"])]:
        spark.catalog.dropTempView(name)
    assert [(f.name, f.dataType) for f in std.schema] == [(f.name, f.dataType) for f in by_sql.schema]
    assert rows_of(std) == rows_of(by_sql)


@pytest.fixture()
def stored_std(spark, tmp_dir):
    fixtures.FixtureCatalog(spark, SMALL)["fx_std"].write.parquet(f"{tmp_dir}/std")
    return spark.read.parquet(f"{tmp_dir}/std")


def test_views_merge_and_standardize_read_their_input_once(spark, stored_std, tmp_dir):
    """Results come from rows written after the one pass, not from the input read again."""
    views = st.statement_views(stored_std, None, "income_statement", 8)
    canonical = stored_std.select("cik").distinct().selectExpr("cik", "CASE WHEN cik LIKE '%1' THEN concat(substr(cik, 1, 9), '0') ELSE cik END AS primary_cik")
    merged = sd.merge_registrants(stored_std, canonical, spark.createDataFrame([], "cik string, priority int"))
    facts = fixtures.FixtureCatalog(spark, SMALL)["facts"].drop("event_id")
    facts.write.parquet(f"{tmp_dir}/facts")
    standard = sd.standardize(spark.read.parquet(f"{tmp_dir}/facts"), literal_table(spark, FIXTURE_STD_RULES, sd.RULE_SCHEMA))
    for out in (views, merged, standard):
        assert out.count() and not [f for f in out.inputFiles() if "/std/" in f or "/facts/" in f]
