"""Delta invariants and the export / manifest path."""
import json
import os

import pytest
from pyspark.sql import functions as F

from finfacts.operators import delta as dl
from finfacts.sinks import export as ex


def test_replace_by_key_keeps_vanished_and_is_idempotent(spark):
    old = spark.createDataFrame([("1", 1.0), ("1", 2.0), ("2", 3.0), ("3", 4.0)], "cik string, v double")
    new = spark.createDataFrame([("1", 9.0), ("4", 5.0)], "cik string, v double")
    once = dl.replace_by_key(old, new)
    assert sorted(map(tuple, once.collect())) == [("1", 9.0), ("2", 3.0), ("3", 4.0), ("4", 5.0)]
    twice = dl.replace_by_key(once, new)   # replaying the batch changes nothing
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_classify_upsert_and_guards(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "cik string, h string")
    new = spark.createDataFrame([("1", "a"), ("2", "c"), ("3", "d")], "cik string, h string")
    st = {r["cik"]: r["status"] for r in dl.classify_changes(new, old).collect()}
    assert st == {"1": "unchanged", "2": "changed", "3": "new"}
    up = dl.upsert_last(old.withColumn("load_seq", F.lit(1)), new.withColumn("load_seq", F.lit(2)), key="cik")
    assert {r["cik"]: r["h"] for r in up.collect()} == {"1": "a", "2": "c", "3": "d"}
    assert dl.check_change_limit(dl.changed_keys(dl.classify_changes(new, old)), limit=2) == 2
    with pytest.raises(RuntimeError):
        dl.check_change_limit(new.select("cik"), limit=2)
    empty = spark.createDataFrame([], "cik string, h string")
    assert dl.full_replace(old, empty).count() == 2
    assert dl.needs_full_rebuild(5, 0) and not dl.needs_full_rebuild(0, 0)


def test_bucketed_export_manifest_and_diff(spark, tmp_dir):
    df = spark.range(0, 500).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"), (F.col("id") * 2).alias("v"))
    out = os.path.join(tmp_dir, "facts")
    ex.write_bucketed(df, out, buckets=8)
    back = spark.read.parquet(out)
    assert back.count() == 500                                       # bucket union == table
    assert back.select("_bkt").distinct().count() == 8
    assert back.where(F.col("_bkt") != F.pmod(F.col("cik").cast("bigint"), F.lit(8))).count() == 0
    files = ex.file_manifest(spark, out, "facts")
    assert files.count() >= 8 and files.where(F.length("sha256") != 64).count() == 0
    counts = ex.row_counts(spark, out, "facts")
    assert ex.reconcile(spark.createDataFrame([("facts", 500)], "table string, rows long"), counts).count() == 0
    doc = json.loads(ex.manifest_json(files, counts, "v1"))
    assert doc["tables"]["facts"]["rows"] == 500
    mpath = os.path.join(tmp_dir, "manifest.json")
    with open(mpath, "w") as fh:
        fh.write(json.dumps(doc))
    listed = ex.manifest_files(spark, mpath)
    assert listed.count() == files.count()
    old = listed.limit(3).union(spark.createDataFrame([("gone.parquet", "x")], "name string, sha256 string"))
    diff = {(r["action"], r["name"]) for r in ex.manifest_diff(listed, old).collect()}
    assert ("RM", "gone.parquet") in diff and len([a for a, _ in diff if a == "UP"]) == files.count() - 3
    plan = {r["action"] for r in ex.sync_plan(listed, listed).collect()}
    assert plan == {"REUSE"}


def test_csv_typed_small_write_append_and_manifest_views(spark, tmp_dir):
    from pyspark.sql import types as T

    from finfacts.plans.jobs import cast_to_schema
    from finfacts.sources import filings, manifest
    schema = T.StructType([T.StructField("cik", T.StringType()), T.StructField("name", T.StringType()),
                           T.StructField("val", T.DoubleType())])
    os.makedirs(f"{tmp_dir}/csv", exist_ok=True)
    with open(f"{tmp_dir}/csv/t.csv", "w") as fh:
        fh.write('cik,name,val\n0000000001,"Acme, ""Inc""",1.5\n0000000002,,\n0000000003,"two\nlines",2\n')
    df = filings.csv_table(spark, f"{tmp_dir}/csv", schema)
    rows = {r["cik"]: r for r in df.collect()}
    assert rows["0000000001"]["name"] == 'Acme, "Inc"' and rows["0000000002"]["name"] is None
    assert rows["0000000002"]["val"] is None and rows["0000000003"]["name"] == "two\nlines"
    typed = cast_to_schema(df.withColumn("extra", F.lit(1)), schema)
    assert typed.columns == ["cik", "name", "val"]
    ex.write_small(typed, f"{tmp_dir}/out/companies")
    ex.append(typed, f"{tmp_dir}/out/companies_log")
    ex.append(typed, f"{tmp_dir}/out/companies_log")
    assert spark.read.parquet(f"{tmp_dir}/out/companies_log").count() == 6
    files = ex.file_manifest(spark, f"{tmp_dir}/out/companies", "companies")
    assert files.count() == 1
    doc = ex.manifest_json(files, ex.row_counts(spark, f"{tmp_dir}/out/companies", "companies"), "v1")
    with open(f"{tmp_dir}/manifest.json", "w") as fh:
        fh.write(doc)
    views = manifest.manifest_tables(spark, f"{tmp_dir}/manifest.json", f"{tmp_dir}/out")
    assert views["companies"].count() == 3 and spark.table("companies").count() == 3
    spark.catalog.dropTempView("companies")
