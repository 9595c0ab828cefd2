"""Readers on small landed files, the zip source, and the streaming refresh."""
import datetime as dt
import json
import os
import zipfile

from pyspark.sql import functions as F

from finfacts.sources import archive, filings
from finfacts.store import Store
from finfacts.streaming import refresh


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as fh:
        fh.write(text)


def test_company_facts_files_and_subset(spark, tmp_dir):
    _write(f"{tmp_dir}/CIK0000000001.json", '{"cik":1,"facts":{}}')
    _write(f"{tmp_dir}/CIK0000000002.json", '{"cik":2,"facts":{}}')
    _write(f"{tmp_dir}/CIK0000000002-submissions-001.json", "{}")
    got = filings.company_facts_files(spark, tmp_dir)
    assert sorted(r["cik"] for r in got.collect()) == ["0000000001", "0000000002"]
    subset = spark.createDataFrame([("0000000002",)], "cik string")
    assert [r["cik"] for r in filings.company_facts_files(spark, tmp_dir, subset).collect()] == ["0000000002"]


def test_submissions_overflow_merge(spark, tmp_dir):
    main = {"cik": "5", "name": "Five", "sic": "7372", "exchanges": ["Nasdaq"],
            "filings": {"recent": {"form": ["10-K", "10-Q"], "accessionNumber": ["a1", "a2"]},
                        "files": [{"name": "CIK0000000005-submissions-001.json"},
                                  {"name": "CIK0000000005-submissions-002.json"}]}}
    _write(f"{tmp_dir}/CIK0000000005.json", json.dumps(main))
    _write(f"{tmp_dir}/CIK0000000005-submissions-002.json", json.dumps({"form": ["8-K"], "accessionNumber": ["a5"]}))
    _write(f"{tmp_dir}/CIK0000000005-submissions-001.json", json.dumps({"form": ["10-K"], "accessionNumber": ["a3"]}))
    _write(f"{tmp_dir}/CIK0000000006.json", "{broken")
    rows = filings.submissions(spark, tmp_dir).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["cik"] == "0000000005" and r["meta"]["sic"] == "7372" and r["exchanges"] == ["Nasdaq"]
    assert r["recent"]["form"] == ["10-K", "10-Q", "10-K", "8-K"]
    assert r["recent"]["accessionNumber"] == ["a1", "a2", "a3", "a5"]


def test_ticker_fund_entity_lists(spark, tmp_dir):
    _write(f"{tmp_dir}/t/tickers.json", json.dumps({
        "10": {"cik_str": 3, "ticker": "c.x", "title": "C"}, "2": {"cik_str": 2, "ticker": "b", "title": "B"},
        "0": {"cik_str": 1, "ticker": "a", "title": "A"}}))
    t = filings.ticker_list(spark, f"{tmp_dir}/t/tickers.json").orderBy("rank").collect()
    assert [(r["ticker"], r["rank"], r["cik"]) for r in t] == [("A", 0, "0000000001"), ("B", 1, "0000000002"),
                                                                ("C-X", 2, "0000000003")]
    _write(f"{tmp_dir}/f/funds.json", json.dumps({"fields": ["cik", "seriesId", "classId", "symbol"],
                                                  "data": [[7, "S1", "C1", "aaa"], [8, "S2", "C1", "bbb"],
                                                           [9, "S3", "C2", "ccc"]]}))
    f = {r["class_id"]: r for r in filings.fund_list(spark, f"{tmp_dir}/f/funds.json").collect()}
    assert f["C1"]["cik"] == "0000000007" and f["C1"]["symbol"] == "AAA" and f["C2"]["series_id"] == "S3"
    _write(f"{tmp_dir}/e/names.txt", "ACME: THE CORP:0000000042:\nCafé Inc:43:\nbroken line\n", encoding="latin-1")
    e = {r["cik"]: r["entity_name"] for r in filings.entity_names(spark, f"{tmp_dir}/e/names.txt").collect()}
    assert e == {"0000000042": "ACME: THE CORP", "0000000043": "Café Inc"}


def test_fx_xml(spark, tmp_dir):
    xml = ('<?xml version="1.0" encoding="UTF-8"?><gesmes:Envelope xmlns:gesmes="http://www.gesmes.org/xml/2002-08-01" '
           'xmlns="http://www.ecb.int/vocabulary/2002-08-01/eurofxref"><gesmes:subject>Reference rates</gesmes:subject>'
           '<Cube><Cube time="2024-01-03"><Cube currency="USD" rate="1.0919"/><Cube currency="JPY" rate="155.52"/></Cube>'
           '<Cube time="2024-01-02"><Cube currency="USD" rate="1.0956"/><Cube currency="XYZ" rate="n/a"/></Cube></Cube>'
           '</gesmes:Envelope>')
    _write(f"{tmp_dir}/fx/rates.xml", xml)
    rows = {(r["rate_date"], r["currency"]): r["rate"] for r in filings.fx_cubes(spark, f"{tmp_dir}/fx/rates.xml").collect()}
    assert rows == {(dt.date(2024, 1, 3), "USD"): 1.0919, (dt.date(2024, 1, 3), "JPY"): 155.52,
                    (dt.date(2024, 1, 2), "USD"): 1.0956}


def test_statement_rules_and_keyed_slice(spark):
    doc = json.dumps({"rows": [{"tag": "total_assets", "xbrl_tags": ["us-gaap:Assets", "dei:X"],
                                "children": [{"xbrl_tags": ["ifrs-full:Assets", "us-gaap:Assets"]}]}]})
    deep = json.dumps({"a": [[{"b": {"xbrl_tags": [{"namespace": "us-gaap", "tag": 'X"]['}, {"namespace": "dei", "tag": "N"}, {"namespace": "us-gaap", "tag": 5},
                                                  {"namespace": "us-gaap"}, 7, None, "us-gaap", ["us-gaap:Y"]]}}]], "xbrl_tags": {"k": "us-gaap:Z"}, "t": '"xbrl_tags": ["us-gaap:No"]'})
    rows = [("balance_sheet", doc), ("cash_flow", deep), ("cash_flow", "no json"), ("cash_flow", None), ("cash_flow", "[]"),
            ("income_statement", "[" * 60 + doc + "]" * 60)]
    r = filings.statement_tag_rules(spark.createDataFrame(rows, "statement string, json string"))
    assert sorted(map(tuple, r.collect())) == [("balance_sheet", "ifrs-full", "Assets"), ("balance_sheet", "us-gaap", "Assets"), ("cash_flow", "us-gaap", 'X"]['),
                                               ("income_statement", "ifrs-full", "Assets"), ("income_statement", "us-gaap", "Assets")]
    df = spark.createDataFrame([("1", 1), ("2", 2)], "cik string, v int")
    assert filings.keyed_slice(df, spark.createDataFrame([("2",)], "cik string")).collect()[0]["v"] == 2


def test_zip_source(spark, tmp_dir):
    path = f"{tmp_dir}/facts.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(5):
            z.writestr(f"CIK{i:010d}.json", json.dumps({"cik": i, "facts": {}}))
        z.writestr("readme.txt", "x")
    archive.register(spark)
    df = (spark.read.format("zipentries").option("path", path).option("pattern", r"^CIK\d+\.json$")
          .option("entriesPerPartition", "2").load())
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["name"] for r in df.collect()) == [f"CIK{i:010d}.json" for i in range(5)]


def _doc(cik, val, extra=()):
    tags = {t: {"label": t, "units": {"USD": [{"end": "2020-12-31", "val": val, "fy": 2020}]}} for t in ("Revenue", *extra)}
    return json.dumps({"cik": cik, "entityName": f"E{cik}", "facts": {"us-gaap": tags}})


def test_streaming_refresh_is_incremental_and_replay_safe(spark, tmp_dir):
    landing, store, ckpt = f"{tmp_dir}/landing", f"{tmp_dir}/store", f"{tmp_dir}/ckpt"
    rules = spark.createDataFrame([("income_statement", "Revenue"), ("balance_sheet", "Assets"),
                                   ("cash_flow", "Capex")], "statement string, tag string")
    _write(f"{landing}/a/CIK0000000001.json", _doc(1, 10, ("Assets", "Capex")))
    _write(f"{landing}/a/CIK0000000002.json", _doc(2, 20))
    refresh.start_refresh(spark, landing, store, ckpt, rules=rules).awaitTermination()
    v1 = refresh.current_version(spark, store)
    assert [r["cik"] for r in Store(spark, store, version=v1).table("processed_ciks").collect()] == ["0000000001"]
    facts, comps = refresh.read_store(spark, store)
    assert sorted((r["cik"], r["val"]) for r in facts.where("tag = 'Revenue'").collect()) == \
        [("0000000001", 10.0), ("0000000002", 20.0)]
    # a changed file for company 2 and an unchanged copy of company 1 arrive
    _write(f"{landing}/b/CIK0000000002.json", _doc(2, 25, ("Assets", "Capex")))
    _write(f"{landing}/b/CIK0000000001.json", _doc(1, 10, ("Assets", "Capex")))
    refresh.start_refresh(spark, landing, store, ckpt, rules=rules).awaitTermination()
    facts, comps = refresh.read_store(spark, store)
    assert sorted((r["cik"], r["val"]) for r in facts.where("tag = 'Revenue'").collect()) == \
        [("0000000001", 10.0), ("0000000002", 25.0)]
    v2 = refresh.current_version(spark, store)
    assert sorted(r["cik"] for r in Store(spark, store, version=v2).table("processed_ciks").collect()) == \
        ["0000000001", "0000000002"]
    # replaying a batch is a no-op
    batch = spark.createDataFrame([("CIK0000000002.json", _doc(2, 25, ("Assets", "Capex")))], "name string, payload string")
    assert refresh.apply_batch(spark, batch, store, 99) == 0
    assert comps.count() == 2
