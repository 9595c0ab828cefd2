"""The versioned store: touched buckets only, one commit, replays, refusals, incremental = full."""
import json
import os

import pytest

from finfacts.plans import jobs
from finfacts.store import Store
from finfacts.streaming import refresh

RULES = [("balance_sheet", "A"), ("income_statement", "B"), ("cash_flow", "C")]
STD_RULES = [("industrial", "balance_sheet", "assets", 1, "us-gaap", "A", "instant"), ("industrial", "income_statement", "revenue", 1, "us-gaap", "B", "instant")]
STD_SCHEMA = "company_type string, statement string, line_item string, priority int, namespace string, tag string, kind string"
DEFINITIONS = [("industrial", "balance_sheet", "assets", "Assets, total", "", None, 1, "+", "debit", "monetary", 1),
               ("industrial", "balance_sheet", "assets", "Total Assets", "", None, 1, "+", "debit", "monetary", 2)]
TABLES = ("facts", "companies", "cik_tags", "processed_ciks", "standardized_statements", "std_lines", "std_presentation", "files_seen")


@pytest.fixture()
def tables(spark):
    return (spark.createDataFrame(RULES, "statement string, tag string"), spark.createDataFrame(STD_RULES, STD_SCHEMA),
            spark.createDataFrame(DEFINITIONS, "company_type string, statement string, tag string, label string, description string, parent string, "
                                               "sequence int, factor string, balance string, unit string, load_seq int"))


def _land(folder, cik, tags):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/CIK{cik:010d}.json", "w") as fh:
        fh.write(json.dumps({"cik": cik, "entityName": f"E{cik}", "facts": {"us-gaap": {
            t: {"label": t, "units": {"USD": [{"end": "2020-12-31", "val": v, "fp": "FY", "accn": f"a{v}"}]}} for t, v in tags.items()}}}))
    os.utime(f"{folder}/CIK{cik:010d}.json", (1_600_000_000, 1_600_000_000))


def _dump(spark, store, name):
    rows = Store(spark, store).table(name)
    return sorted(map(str, rows.select(sorted(rows.columns)).collect()))


def test_incremental_equals_full_after_new_changed_emptied_and_vanished(spark, tmp_dir, tables):
    rules, std_rules, definitions = tables
    land, land2, store = f"{tmp_dir}/land", f"{tmp_dir}/land2", f"{tmp_dir}/store"
    for cik in range(1, 9):
        _land(land, cik, {"A": cik, "B": cik, "C": 1} if cik != 3 else {"A": 3})
    jobs.build_facts(spark, land, store, rules, std_rules=std_rules, definitions=definitions, buckets=4)
    _land(land2, 1, {"A": 1, "B": 1, "C": 1})                # unchanged
    _land(land2, 2, {"A": 20, "C": 5})                       # changed, no longer processed
    _land(land2, 3, {"A": 3, "B": 30, "C": 3})               # changed, processed now
    _land(land2, 4, {})                                      # emptied
    _land(land2, 9, {"A": 9, "B": 9, "C": 9})                # new; 5 to 8 vanish
    n = jobs.update_facts(spark, land2, store, rules, std_rules=std_rules, definitions=definitions, complete=True)
    assert n == 8
    full = f"{tmp_dir}/full"
    jobs.build_facts(spark, land2, full, rules, std_rules=std_rules, definitions=definitions, buckets=4)
    for name in TABLES:
        assert _dump(spark, store, name) == _dump(spark, full, name), name
    assert _dump(spark, store, "facts") and [r["label"] for r in Store(spark, store).table("std_presentation").where("tag = 'assets'").collect()] == ["Total Assets"]
    # Dictionaries keep what they held.
    ids = {r["tag"]: r["id"] for r in Store(spark, store, version=1).table("xbrl_tags").collect()}
    assert {r["tag"]: r["id"] for r in Store(spark, store).table("xbrl_tags").collect()} == ids


def test_untouched_buckets_keep_their_files(spark, tmp_dir, tables):
    rules, std_rules, _ = tables
    land, store = f"{tmp_dir}/land", f"{tmp_dir}/store"
    for cik in range(16):
        _land(land, cik + 1, {"A": cik, "B": 1, "C": 1})
    jobs.build_facts(spark, land, store, rules, std_rules=std_rules, buckets=8)
    before = Store(spark, store)
    _land(land, 3, {"A": 99, "B": 1, "C": 1})
    assert jobs.update_facts(spark, land, store, rules, std_rules=std_rules) == 1
    after = Store(spark, store)
    for name in ("facts", "companies", "processed_ciks", "standardized_statements"):
        old, new = before.state["tables"][name]["files"], after.state["tables"][name]["files"]
        assert {b for b in new if new[b] != old.get(b)} == {"3"} and set(old) == set(new)
    assert [r["val"] for r in after.table("facts").where("cik = '0000000003' and tag = 'A'").collect()] == [99.0]
    assert before.table("facts").where("val = 99").count() == 0         # the earlier version reads as it was


def test_replay_changes_nothing_also_without_facts(spark, tmp_dir, tables):
    rules, std_rules, _ = tables
    land, store = f"{tmp_dir}/land", f"{tmp_dir}/store"
    _land(land, 1, {"A": 1})
    _land(land, 2, {})                                       # a company without facts
    jobs.build_facts(spark, land, store, rules)
    assert [jobs.update_facts(spark, land, store, rules) for _ in range(3)] == [0, 0, 0]
    assert Store(spark, store).version == 1
    batch = spark.createDataFrame([("CIK0000000007.json", '{"cik":7,"facts":{}}')], "name string, payload string")
    assert refresh.apply_batch(spark, batch, store, 5, rules) == 1 and refresh.apply_batch(spark, batch, store, 6, rules) == 0


def test_versions_are_not_reused_and_unpublished_work_is_not_seen(spark, tmp_dir, tables):
    rules, _, _ = tables
    land, store = f"{tmp_dir}/land", f"{tmp_dir}/store"
    _land(land, 1, {"A": 1})
    jobs.build_facts(spark, land, store, rules)
    _land(land, 1, {"A": 2})
    assert jobs.update_facts(spark, land, store, rules, version=4) == 1
    with pytest.raises(ValueError):
        jobs.build_submissions(spark, land, store, version=4)
    with pytest.raises(ValueError):
        jobs.update_facts(spark, land, store, rules, version=2)
    base = Store(spark, store)
    dead = base.begin()
    dead.overwrite("facts", base.table("facts").limit(0))               # a writer that dies here
    assert Store(spark, store).version == 4 and Store(spark, store).table("facts").count() == 1
    first, second = base.begin(), base.begin()
    first.overwrite("facts", base.table("facts"))
    second.overwrite("facts", base.table("facts").limit(0))
    first.publish()
    with pytest.raises(RuntimeError):
        second.publish()
    assert Store(spark, store).version == 5 and Store(spark, store).table("facts").count() == 1


def test_rules_given_later_build_derived_tables_in_full(spark, tmp_dir, tables):
    rules, std_rules, definitions = tables
    store = f"{tmp_dir}/store"

    def batch(cik, val):
        doc = {"cik": cik, "facts": {"us-gaap": {t: {"units": {"USD": [{"end": "2020-12-31", "val": val, "fp": "FY"}]}} for t in "ABC"}}}
        return spark.createDataFrame([(f"CIK{cik:010d}.json", json.dumps(doc))], "name string, payload string")

    assert refresh.apply_batch(spark, batch(1, 1), store, 1) == 1
    assert refresh.apply_batch(spark, batch(2, 2), store, 2, rules) == 1
    assert sorted(r["cik"] for r in Store(spark, store).table("processed_ciks").collect()) == ["0000000001", "0000000002"]
    assert refresh.apply_batch(spark, batch(2, 2), store, 3, rules, std_rules, definitions) == 0       # nothing changed, but statements are due
    assert Store(spark, store).table("standardized_statements").count() == 4
    assert refresh.apply_batch(spark, batch(2, 2), store, 4, rules, std_rules, definitions) == 0 and Store(spark, store).version == 3


def test_dictionary_clash_decodes_right(spark):
    from pyspark.sql import functions as F

    from finfacts.operators import dictionaries as dc

    def poor(cols, salt):                                   # nearly all keys clash, with salts too
        return F.pmod(F.xxhash64(*cols), F.lit(3)) + F.lit(0 if salt < 3 else 100 * salt)
    first = spark.createDataFrame([("a", "old", 2), ("b", "B", 1), ("a", "older", 1)], "k string, label string, o int")
    more = spark.createDataFrame([(k, f"new {k}", 0) for k in "abcdef"], "k string, label string, o int")
    d1 = dc.dictionary_delta(None, first, ["k"], ["label"], "o", poor)
    d2 = dc.dictionary_delta(d1, more, ["k"], ["label"], "o", poor)
    rows = {r["k"]: r for r in d2.collect()}
    assert len({r["id"] for r in rows.values()}) == 6 and rows["a"]["label"] == "older" and rows["c"]["label"] == "new c"
    assert {r["k"]: r["id"] for r in d1.collect()} == {k: rows[k]["id"] for k in "ab"}
    data = spark.createDataFrame([(i, k) for i, k in enumerate("abcdefa")] + [(9, None)], "i int, k string")
    back = dc.decode_key(dc.encode_key(data, d2, ["k"], "id", poor), d2, ["k"], "id", spread=["i"])
    assert sorted(map(tuple, back.select("i", "k").collect()), key=str) == sorted(map(tuple, data.collect()), key=str)


def test_asof_join_against_a_loop(spark):
    import datetime as dt
    import random

    from finfacts.operators.asof import asof_join
    r = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(r.randrange(400))
    left = [(i, r.choice("aaaab"), day()) for i in range(300)] + [(1000, None, day()), (1001, "a", None), (1002, "z", day())]
    right = [(r.choice("aaab"), day(), float(i)) for i in range(40)] + [("a", None, 1.0), (None, day(), 2.0)]
    lf, rf = spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, q date, v double")
    for span in (1, 30, 5000):
        got = {x["i"]: (x["q"], x["v"]) for x in asof_join(lf, rf, ["k"], "d", "q", ["v"], span).collect()}
        for i, k, d in left:
            hits = [(q, v) for rk, q, v in right if k is not None and d is not None and rk == k and q is not None and q <= d]
            assert got[i] == (max(hits) if hits else (None, None)), (span, i)


def test_components_of_chains(spark):
    from finfacts.operators.components import connected_components
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60) if i != 30] + [("x", "x"), ("y", "z"), ("z", "y")]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(got[f"n{i:03d}"] == ("n000" if i <= 30 else "n031") for i in range(61)) and got["x"] == "x" and got["z"] == "y"
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_sketched_medians_keep_their_error(spark):
    from pyspark.sql import functions as F

    from finfacts.operators import rollup
    std = spark.range(1, 2001).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"), F.explode(F.array(
        F.struct(F.lit("total_revenue").alias("tag"), F.lit(100.0).alias("val")), F.struct(F.lit("net_income").alias("tag"), F.col("id").cast("double").alias("val")))).alias("x")) \
        .select("cik", "x.tag", "x.val", F.lit("annual").alias("frequency"), F.to_date(F.lit("2020-12-31")).alias("period_ending"), F.lit(2020).alias("fiscal_year"),
                F.lit("FY").alias("fiscal_period"))
    sectors = std.select("cik", F.lit("S").alias("sector"), F.lit("I").alias("industry"), F.lit("U").alias("sub_industry")).distinct()
    exact = rollup.sector_medians(sectors, std, as_of="2021-06-01").where("level = 'sector'").collect()[0]
    near = rollup.sector_medians(sectors, std, as_of="2021-06-01", accuracy=100).where("level = 'sector'").collect()[0]
    assert exact["median_net_margin"] == 1000.5 and abs(near["median_net_margin"] - 1000) <= 2000 / 100
