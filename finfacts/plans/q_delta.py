"""Delta and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.operators import delta as dl
from finfacts.plans.registry import query, sql
from finfacts.sinks import export as ex

_H = ["fx_hash_old", "fx_hash_new"]
TOUCH_BUCKETS = 1024


@query("delta_classify", "K1 K2", sql(_H, [], """
SELECT n.cik, CASE WHEN o.h IS NULL THEN 'new' WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status
FROM fx_hash_new n LEFT JOIN fx_hash_old o ON o.cik = n.cik"""))
def delta_classify(c):
    return dl.classify_changes(c["fx_hash_new"], c["fx_hash_old"])


@query("replace_by_key", "B9 K3 K5 D11 (changed companies' rows replaced)", sql(_H + ["fx_std"], [
    ("changed", "SELECT n.cik FROM fx_hash_new n LEFT JOIN fx_hash_old o ON o.cik = n.cik WHERE o.h IS NULL OR o.h <> n.h")], """
SELECT s.* FROM fx_std s LEFT JOIN changed c ON c.cik = s.cik WHERE s.frequency = if(c.cik IS NULL, 'annual', 'quarterly')"""))
def replace_by_key(c):
    # Snapshot = annual rows; the delta batch = quarterly rows of new or changed companies.
    std = c["fx_std"]
    keys = dl.changed_keys(dl.classify_changes(c["fx_hash_new"], c["fx_hash_old"]))
    batch = std.where(F.col("frequency") == "quarterly").join(keys, "cik", "left_semi")
    return dl.replace_by_key(std.where(F.col("frequency") == "annual"), batch, changed=keys)


@query("rewritten_buckets", "B9 J1 B2 (buckets that a delta rewrites; the others are taken over)", sql(_H + ["fx_std"], [
    ("changed", "SELECT n.cik FROM fx_hash_new n LEFT JOIN fx_hash_old o ON o.cik = n.cik WHERE o.h IS NULL OR o.h <> n.h")], f"""
SELECT CAST(CAST(s.cik AS BIGINT) % {TOUCH_BUCKETS} AS INTEGER) AS bucket, count(DISTINCT c.cik) AS changed, count(c.cik) AS rows_replaced,
       count(*) - count(c.cik) AS rows_kept
FROM fx_std s LEFT JOIN changed c ON c.cik = s.cik GROUP BY 1 HAVING count(c.cik) > 0"""))
def rewritten_buckets(c):
    keys = dl.changed_keys(dl.classify_changes(c["fx_hash_new"], c["fx_hash_old"]))
    return dl.touched_buckets(c["fx_std"], keys, TOUCH_BUCKETS)


@query("upsert_last", "B11 (last load wins per key)", sql(_H, [], """
SELECT cik, arg_max(h, load_seq) AS h FROM (
  SELECT cik, h, 1 AS load_seq FROM fx_hash_old UNION ALL SELECT cik, h, 2 FROM fx_hash_new) u GROUP BY cik"""))
def upsert_last(c):
    old = c["fx_hash_old"].withColumn("load_seq", F.lit(1))
    new = c["fx_hash_new"].withColumn("load_seq", F.lit(2))
    return dl.upsert_last(old, new, key="cik", order="load_seq")


def _files(df):
    # A manifest's file list: one file per company, its content hash.
    return df.select(F.concat(F.lit("facts-"), F.col("cik"), F.lit(".parquet")).alias("name"), F.col("h").alias("sha256"))


_FILES = ("SELECT 'facts-' || cik || '.parquet' AS name, h AS sha256 FROM {t}")


@query("manifest_diff", "B6", sql(_H, [("n", _FILES.format(t="fx_hash_new")), ("o", _FILES.format(t="fx_hash_old"))], """
SELECT CASE WHEN n.name IS NOT NULL THEN 'UP' ELSE 'RM' END AS action, coalesce(n.name, o.name) AS name
FROM n FULL OUTER JOIN o ON o.name = n.name
WHERE (n.name IS NOT NULL AND (o.sha256 IS NULL OR o.sha256 <> n.sha256)) OR n.name IS NULL"""))
def manifest_diff(c):
    return ex.manifest_diff(_files(c["fx_hash_new"]), _files(c["fx_hash_old"]))


@query("sync_plan", "B7", sql(_H, [("n", _FILES.format(t="fx_hash_new")), ("o", _FILES.format(t="fx_hash_old"))], """
SELECT n.name, CASE WHEN o.sha256 IS NOT NULL AND o.sha256 = n.sha256 THEN 'REUSE' ELSE 'FETCH' END AS action
FROM n LEFT JOIN o ON o.name = n.name"""))
def sync_plan(c):
    return ex.sync_plan(_files(c["fx_hash_new"]), _files(c["fx_hash_old"]))


@query("bucket_counts", "B2 B3 (cik % 64 buckets)", sql(["fx_std"], [], """
SELECT CAST(CAST(cik AS BIGINT) % 64 AS INTEGER) AS bucket, count(*) AS rows, count(DISTINCT cik) AS companies
FROM fx_std GROUP BY 1"""))
def bucket_counts(c):
    return ex.bucket_counts(c["fx_std"])
