"""Document queries checked against plain-Python brute force on the smallest fixture."""
import hashlib
import json

import __spark_entry__ as E
from conftest import SMALL
from finfacts.operators import facts as fa
from finfacts.plans.fixtures import FixtureCatalog


def test_facts_document_matches_python(spark):
    c = FixtureCatalog.get(spark, SMALL)
    docs = [r["payload"] for r in c["fx_doc"].orderBy("event_id").collect()]
    expected: dict = {}
    for text in docs:
        d = json.loads(text)
        cik = str(d["cik"]).lstrip("0").rjust(10, "0") if str(d["cik"]).lstrip("0") else "0000000000"
        doc = expected.setdefault(cik, {"cik": cik, "entityName": d.get("entityName") or "", "facts": {}})
        for ns, tags in d["facts"].items():
            for tag, obj in tags.items():
                t = doc["facts"].setdefault(ns, {}).setdefault(tag, {"label": "", "description": "", "units": {}})
                t["label"], t["description"] = max(t["label"], obj["label"]), max(t["description"], obj["description"])
                for unit, periods in obj["units"].items():
                    for p in periods:
                        try:
                            fy = int(p["fy"])
                        except (TypeError, ValueError):
                            fy = None
                        record = {"end": p["end"], "val": float(p["val"]), "accn": p.get("accn"), "fy": fy, "fp": p.get("fp"),
                                  "form": p.get("form"), "filed": p["filed"] if len(p["filed"]) == 10 else None}
                        record |= {k: p[k] for k in ("start", "frame") if p.get(k)}
                        t["units"].setdefault(unit, []).append(record)
    for doc in expected.values():
        for tags in doc["facts"].values():
            for t in tags.values():
                for unit in t["units"]:
                    t["units"][unit].sort(key=lambda r: (r["end"], json.dumps(r, sort_keys=True)))
    parts = E.queries()["facts_document"](spark, SMALL)
    got = {r["cik"]: json.loads(r["document"]) for r in fa.assemble_documents(parts).collect()}
    for doc in got.values():
        for tags in doc["facts"].values():
            for t in tags.values():
                for unit in t["units"]:
                    t["units"][unit].sort(key=lambda r: (r["end"], json.dumps(r, sort_keys=True)))
    assert got == expected


def test_canonical_hash_matches_python(spark):
    df = E.queries()["canonical_payload_hash"](spark, SMALL)
    c = FixtureCatalog.get(spark, SMALL)
    payload = {r["event_id"]: r["payload"] for r in c["fx_doc"].collect()}
    for r in df.collect():
        text = payload[r["event_id"]]
        # Numbers that are equal read alike: 12.0 is 12.
        whole = json.loads(text, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
        canon = json.dumps(whole, separators=(",", ":"), sort_keys=True)
        assert r["canonical_sha256"] == hashlib.sha256(canon.encode()).hexdigest()
        assert r["raw_sha256"] == hashlib.sha256(text.encode()).hexdigest()
