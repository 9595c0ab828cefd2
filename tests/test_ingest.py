"""Facts explode, documents, DEI rows, processed flags, FX triangulation on literal rows."""
import datetime as dt
import json

from finfacts.operators import facts as fa
from finfacts.operators import fx

DOCS = [
    '{"cik":1,"entityName":"A","facts":{"us-gaap":{"A":"oops","B":{"label":"b","units":{"USD":['
    '{"end":"2020-01-01","val":1.5,"fy":2020,"frame":"CY2019"},5,{"end":"2021-01-01","val":"x","fy":"2021",'
    '"start":"2020-01-01"}]}}}}}',
    '{"cik":"0002","facts":{"dei":[1,2],"us-gaap":{"C":{"label":"c","units":{"USD":[{"end":"2020-01-01","val":2}],'
    '"EUR":"bad"}}}}}',
    'not json',
    '{"cik":"0003","entityName":"NoFacts","facts":{}}',
]


def test_explode_skips_only_malformed_levels(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, payload string")
    rows = fa.explode_company_facts(df, "payload", "id").collect()
    got = sorted((r["cik"], r["tag"], r["unit"], str(r["end"]), r["val"], r["fy"]) for r in rows)
    assert got == [("0000000001", "B", "USD", "2020-01-01", 1.5, 2020),
                   ("0000000001", "B", "USD", "2021-01-01", None, 2021),
                   ("0000000002", "C", "USD", "2020-01-01", 2.0, None)]
    comps = fa.companies_from_facts(fa.explode_company_facts(df, "payload", "id"), "id").collect()
    assert sorted(r["cik"] for r in comps) == ["0000000001", "0000000002"]   # no facts -> no company


def test_document_shape(spark):
    df = spark.createDataFrame([(0, DOCS[0])], "id int, payload string")
    f = fa.explode_company_facts(df, "payload", "id")
    parts = fa.company_document_parts(f, fa.companies_from_facts(f, "id"))
    frag = json.loads(parts.collect()[0]["fragment"])
    assert frag["label"] == "b" and list(frag["units"]) == ["USD"]
    doc = json.loads(fa.assemble_documents(parts).collect()[0]["document"])
    recs = doc["facts"]["us-gaap"]["B"]["units"]["USD"]
    assert doc["cik"] == "0000000001" and doc["entityName"] == "A"
    assert recs[0] == {"end": "2020-01-01", "val": 1.5, "accn": None, "fy": 2020, "fp": None, "form": None,
                       "filed": None, "frame": "CY2019"}
    assert "frame" not in recs[1] and recs[1]["start"] == "2020-01-01"


def test_encode_decode_identity(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, payload string")
    f = fa.explode_company_facts(df, "payload", "id")
    enc, tags, accns = fa.encode(f)
    fa.assert_unique_ids(tags, "tag_id")
    back = fa.decode(enc, tags, accns).select(*f.columns)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, f.collect())))


def test_dei_facts(spark):
    sub = spark.createDataFrame([("0000000001", {"sic": "7372", "sicDescription": "Software", "name": "", "ein": None},
                                  dt.datetime(2024, 5, 1, 12)),
                                 ("0000000002", {"sic": "n/a", "stateOfIncorporation": "DE"}, dt.datetime(2024, 5, 2))],
                                "cik string, meta map<string,string>, mtime timestamp")
    rows = {(r["cik"], r["tag"]): r for r in fa.dei_facts(sub).collect()}
    assert rows[("0000000001", "EntitySicCode")]["val"] == 7372.0
    assert rows[("0000000001", "EntitySicCode")]["unit"] == "pure"
    assert rows[("0000000001", "EntitySicDescription")]["val_text"] == "Software"
    assert ("0000000001", "EntityName") not in rows            # empty -> skipped
    assert ("0000000002", "EntitySicCode") not in rows         # not numeric -> skipped
    r = rows[("0000000002", "EntityStateOfIncorporation")]
    assert r["end"] == r["filed"] == dt.date(2024, 5, 2) and r["form"] == "submissions"


def test_processed_requires_all_three(spark):
    f = spark.createDataFrame([("1", "us-gaap", "a"), ("1", "us-gaap", "b"), ("1", "ifrs-full", "c"),
                               ("2", "us-gaap", "a"), ("2", "dei", "b"), ("2", "us-gaap", "c")],
                              "cik string, namespace string, tag string")
    rules = spark.createDataFrame([("balance_sheet", "a"), ("income_statement", "b"), ("cash_flow", "c")],
                                  "statement string, tag string")
    assert [r["cik"] for r in fa.processed_companies(f, rules).collect()] == ["1"]


def test_triangulation(spark):
    cubes = spark.createDataFrame([
        (dt.date(2024, 1, 2), "USD", 1.1), (dt.date(2024, 1, 2), "JPY", 160.0), (dt.date(2024, 1, 2), "XXX", 0.0),
        (dt.date(2024, 1, 3), "JPY", 161.0)], "rate_date date, currency string, rate double")
    got = {(r["rate_date"], r["from_currency"]): r["rate"] for r in fx.triangulate_to_usd(cubes, "2024-06-01").collect()}
    d = dt.date(2024, 1, 2)
    assert got[(d, "USD")] == 1.0 and got[(d, "EUR")] == 1.1
    assert abs(got[(d, "JPY")] - 1.1 / 160.0) < 1e-15
    assert got[(d, "XXX")] is None                            # zero quote -> null
    assert not any(k[0] == dt.date(2024, 1, 3) for k in got)  # no USD quote that day
