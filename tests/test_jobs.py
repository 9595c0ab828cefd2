"""Full build vs delta build on landed files; statement views."""
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from finfacts.plans import jobs
from finfacts.plans.fixtures import FixtureCatalog


def _doc(cik, tags):
    return json.dumps({"cik": cik, "entityName": f"E{cik}", "facts": {"us-gaap": {
        t: {"label": t, "units": {"USD": [{"end": "2020-12-31", "val": v}]}} for t, v in tags.items()}}})


def _land(d, cik, tags):
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/CIK{cik:010d}.json", "w") as fh:
        fh.write(_doc(cik, tags))


def test_full_and_delta_build_agree(spark, tmp_dir):
    rules = spark.createDataFrame([("balance_sheet", "A"), ("income_statement", "B"), ("cash_flow", "C")],
                                  "statement string, tag string")
    land, store = f"{tmp_dir}/land", f"{tmp_dir}/store"
    _land(land, 1, {"A": 1, "B": 2, "C": 3})
    _land(land, 2, {"A": 1})
    jobs.build_facts(spark, land, store, rules)
    assert jobs.latest_table(spark, store, "processed_ciks").collect()[0]["cik"] == "0000000001"
    # company 2 changes, company 3 arrives, company 1 unchanged
    _land(land, 2, {"A": 5, "B": 6, "C": 7})
    _land(land, 3, {"B": 1})
    assert jobs.update_facts(spark, land, store, rules, version=2) == 2
    delta_facts = jobs.latest_table(spark, store, "facts")
    full = f"{tmp_dir}/full"
    jobs.build_facts(spark, land, full, rules)
    cols = ["cik", "namespace", "tag", "unit", "end", "val"]
    assert sorted(map(tuple, delta_facts.select(*cols).collect())) == \
        sorted(map(tuple, jobs.latest_table(spark, full, "facts").select(*cols).collect()))
    assert sorted(r["cik"] for r in jobs.latest_table(spark, store, "processed_ciks").collect()) == \
        ["0000000001", "0000000002"]


def test_multi_cik_overrides(spark, tmp_dir):
    p = f"{tmp_dir}/multi.json"
    with open(p, "w") as fh:
        fh.write(json.dumps({"brk.a": ["1067983", "0000000001"]}))
    rows = sorted(map(tuple, jobs.multi_cik_overrides(spark, p).collect()))
    assert rows == [("BRK-A", "0000000001", 1), ("BRK-A", "0001067983", 0)]


@pytest.mark.parametrize("period,transform", sorted(jobs.VIEW_MATRIX))
def test_statement_views(spark, period, transform):
    c = FixtureCatalog.get(spark, SMALL)
    v = jobs.statement_view(c["fx_std"], c["fx_rates"], "income_statement", period, transform, limit=4)
    assert v.agg(F.max("period_rank")).collect()[0][0] <= 4
    assert v.count() > 0


def test_submissions_replace_only_dei_rows(spark, tmp_dir):
    rules = spark.createDataFrame([("balance_sheet", "A")], "statement string, tag string")
    land, subs, store = f"{tmp_dir}/land", f"{tmp_dir}/subs", f"{tmp_dir}/store"
    _land(land, 1, {"A": 1})
    built = jobs.build_facts(spark, land, store, rules)
    assert built["facts"].count() == 1
    os.makedirs(subs, exist_ok=True)
    with open(f"{subs}/CIK0000000001.json", "w") as fh:
        fh.write(json.dumps({"cik": "1", "name": "One", "sic": "7372", "sicDescription": "Software",
                             "filings": {"recent": {"form": ["10-K"]}, "files": []}}))
    assert jobs.build_submissions(spark, subs, store) == 1
    f = jobs.latest_table(spark, store, "facts")
    got = sorted((r["namespace"], r["tag"]) for r in f.collect())
    assert got == [("dei", "EntityName"), ("dei", "EntitySicCode"), ("dei", "EntitySicDescription"), ("us-gaap", "A")]
    s = jobs.latest_table(spark, store, "submissions").collect()[0]
    assert len(s["h"]) == 64 and s["payload"][:2] == bytes([0x1F, 0x8B])


def test_export_store_manifest_and_reconcile(spark, tmp_dir):
    from finfacts.sinks import export as ex
    c = FixtureCatalog.get(spark, SMALL)
    tables = {"fx_std": c["fx_std"], "fx_companies": c["fx_companies"], "fx_rates": c["fx_rates"]}
    out = f"{tmp_dir}/export"
    doc = json.loads(jobs.export_store(spark, tables, out, bucketed={"fx_std"}, data_version="r1", buckets=8))
    assert doc["data_version"] == "r1" and set(doc["tables"]) == set(tables)
    for name, df in tables.items():
        assert doc["tables"][name]["rows"] == df.count()
    assert len(doc["tables"]["fx_companies"]["files"]) == 1
    assert spark.read.parquet(f"{out}/fx_std").select("_bkt").distinct().count() == 8
    written = spark.read.text(f"{out}/_manifest").collect()[0]["value"]
    assert json.loads(written)["tables"]["fx_std"]["rows"] == tables["fx_std"].count()
    mf = f"{tmp_dir}/m.json"
    with open(mf, "w") as fh:
        fh.write(written)
    assert ex.manifest_files(spark, mf).count() == sum(len(t["files"]) for t in doc["tables"].values())


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_refresh_symbols_keeps_vanished_companies(spark, tmp_dir):
    store = f"{tmp_dir}/store"
    _w(f"{tmp_dir}/t1/tickers.json", json.dumps({"0": {"cik_str": 1, "ticker": "aaa", "title": "A"},
                                                 "1": {"cik_str": 2, "ticker": "bbb", "title": "B"}}))
    _w(f"{tmp_dir}/f/funds.json", json.dumps({"fields": ["cik", "seriesId", "classId", "symbol"],
                                              "data": [[7, "S1", "C1", "fff"]]}))
    _w(f"{tmp_dir}/e/names.txt", "A CORP:1:\nB CORP:2:\n")
    jobs.refresh_symbols(spark, f"{tmp_dir}/t1/tickers.json", f"{tmp_dir}/f/funds.json", f"{tmp_dir}/e/names.txt", store)
    # company 2 vanishes from the list, company 1 changes ticker
    _w(f"{tmp_dir}/t2/tickers.json", json.dumps({"0": {"cik_str": 1, "ticker": "aab", "title": "A"}}))
    jobs.refresh_symbols(spark, f"{tmp_dir}/t2/tickers.json", f"{tmp_dir}/f/funds.json", f"{tmp_dir}/e/names.txt",
                         store)
    got = sorted((r["cik"], r["ticker"]) for r in jobs.latest_table(spark, store, "tickers").collect())
    assert got == [("0000000001", "AAB"), ("0000000002", "BBB")]


def test_rebuild_fx_and_empty_download_guard(spark, tmp_dir):
    store = f"{tmp_dir}/store"
    xml = ('<Envelope><Cube><Cube time="2024-01-03"><Cube currency="USD" rate="1.1"/><Cube currency="JPY" rate="160"/>'
           '</Cube></Cube></Envelope>')
    _w(f"{tmp_dir}/fx1/r.xml", xml)
    rates = jobs.rebuild_fx(spark, f"{tmp_dir}/fx1/r.xml", store, as_of="2024-06-01")
    assert sorted(r["from_currency"] for r in rates.collect()) == ["EUR", "JPY", "USD"]
    _w(f"{tmp_dir}/fx2/r.xml", "<Envelope><Cube></Cube></Envelope>")
    kept = jobs.rebuild_fx(spark, f"{tmp_dir}/fx2/r.xml", store, as_of="2024-06-01")
    assert kept.count() == 3


def test_both_jobs_build_on_the_latest_version(spark, tmp_dir):
    rules = spark.createDataFrame([("balance_sheet", "A")], "statement string, tag string")
    land, subs, store = f"{tmp_dir}/land", f"{tmp_dir}/subs", f"{tmp_dir}/store"
    _land(land, 1, {"A": 2})
    jobs.build_facts(spark, land, store, rules)
    _land(land, 1, {"A": 9})
    assert jobs.update_facts(spark, land, store, rules, version=2) == 1
    _w(f"{subs}/CIK0000000001.json", json.dumps({"cik": "1", "name": "One", "filings": {"recent": {"form": ["10-K"]}, "files": []}}))
    assert jobs.build_submissions(spark, subs, store, version=3) == 1
    facts = jobs.latest_table(spark, store, "facts")
    assert [r["val"] for r in facts.where("tag = 'A'").collect()] == [9.0]


def test_changed_file_without_facts_loses_its_old_facts(spark, tmp_dir):
    rules = spark.createDataFrame([("balance_sheet", "A")], "statement string, tag string")
    land, store = f"{tmp_dir}/land", f"{tmp_dir}/store"
    _land(land, 1, {"A": 2})
    _land(land, 2, {"A": 3})
    jobs.build_facts(spark, land, store, rules)
    _land(land, 1, {})
    assert jobs.update_facts(spark, land, store, rules, version=2) == 1
    assert [r["cik"] for r in jobs.latest_table(spark, store, "facts").collect()] == ["0000000002"]


def test_facts_of_changed_submissions_only(spark, tmp_dir):
    rules = spark.createDataFrame([("balance_sheet", "A")], "statement string, tag string")
    land, subs, store = f"{tmp_dir}/land", f"{tmp_dir}/subs", f"{tmp_dir}/store"
    _land(land, 1, {"A": 1})
    _land(land, 2, {"A": 1})
    jobs.build_facts(spark, land, store, rules)
    os.makedirs(subs, exist_ok=True)
    with open(f"{subs}/CIK0000000001.json", "w") as fh:
        fh.write(json.dumps({"cik": "1", "name": "One", "filings": {"recent": {"form": ["10-K"]}, "files": []}}))
    jobs.build_submissions(spark, subs, store, version=2)
    _land(land, 1, {"A": 9})
    _land(land, 2, {"A": 9})
    assert jobs.update_facts(spark, land, store, rules, version=3, ciks=jobs.changed_submissions(spark, store, 2)) == 1
    facts = jobs.latest_table(spark, store, "facts")
    assert sorted((r["cik"], r["val"]) for r in facts.where("tag = 'A'").collect()) == [("0000000001", 9.0), ("0000000002", 1.0)]
    assert facts.where("form = 'submissions'").count() == 1             # facts from filing metadata outlive a change of the facts file
    assert jobs.changed_submissions(spark, store, 3).count() == 0


def test_sic_rules_from_a_file(spark, tmp_dir):
    from finfacts.sources import filings
    with open(f"{tmp_dir}/sic.csv", "w") as fh:
        fh.write('code,sector,industry\n08,Materials,Forestry\n2834,Health Care,"Drugs, etc."\nx,y,z\n')
    assert sorted(map(tuple, filings.sic_rules(spark, f"{tmp_dir}/sic.csv").collect())) == [
        (2, 8, "Materials", "Forestry"), (4, 2834, "Health Care", "Drugs, etc.")]
