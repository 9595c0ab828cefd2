"""Parquet export: typed single-file tables, cik-bucketed big tables, checksummed
manifests, manifest diff and sync plans (B1-B8)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def with_bucket(df: DataFrame, key: str = "cik", buckets: int = BUCKETS, name: str = "_bkt") -> DataFrame:
    """Bucket number = numeric cik modulo ``buckets`` (cik is a zero-padded digit string)."""
    return df.withColumn(name, F.pmod(F.col(key).cast("bigint"), F.lit(buckets)).cast("int"))


def bucket_counts(df: DataFrame, key: str = "cik", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, companies) — what a bucketed export would write per file."""
    b = with_bucket(df, key, buckets, "bucket")
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("companies"))


def write_small(df: DataFrame, path: str) -> None:
    """zstd Parquet files without buckets: one for a small table (dimension or lookup), as adaptive execution merges
    small partitions, and several for a table that turns out large."""
    df.hint("rebalance").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str = "cik", buckets: int = BUCKETS, sort: bool = True) -> None:
    """Big table as ``_bkt=<n>/`` folders, rows sorted by cik inside each file.

    A ``REBALANCE(_bkt)`` hint shuffles rows by bucket, so a task writes files of one
    bucket only (one open writer, bounded memory), and lets AQE split a bucket that
    is too large — a company holding a third of the rows is written by several
    tasks, as several files in its bucket folder — and merge tiny ones. Readers
    prune buckets by the folder and skip row groups by cik.
    """
    b = with_bucket(df, key, buckets).hint("rebalance", "_bkt")
    if sort:
        b = b.sortWithinPartitions("_bkt", key)
    b.write.mode("overwrite").option("compression", "zstd").partitionBy("_bkt").parquet(path)


def file_manifest(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(table, name, sha256, bytes) for every Parquet file under ``path``.

    Files are hashed by the executors that read them (binaryFile source); only the
    small manifest rows come back.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(path))
    return files.select(F.lit(table).alias("table"),
                        F.regexp_replace(F.col("path"), r"^.*?/" + table.replace(".", r"\.") + "/", "").alias("name"),
                        F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("bytes"))


def row_counts(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table"), "rows")


def reconcile(source_counts: DataFrame, written_counts: DataFrame) -> DataFrame:
    """Tables whose written row count differs from the source (empty = all good)."""
    j = source_counts.alias("s").join(written_counts.alias("w"), "table", "full_outer")
    return j.where(~F.col("s.rows").eqNullSafe(F.col("w.rows"))).select(
        "table", F.col("s.rows").alias("source_rows"), F.col("w.rows").alias("written_rows"))


def manifest_json(files: DataFrame, counts: DataFrame, data_version: str) -> str:
    """Manifest document: one row per *file* goes to the driver (some hundred bytes each), never data rows. For
    tables of very many files use ``file_manifest`` itself, which is a table."""
    tables: dict = {}
    for r in files.orderBy("table", "name").collect():
        tables.setdefault(r["table"], {"files": [], "rows": None})["files"].append(
            {"name": r["name"], "sha256": r["sha256"], "bytes": r["bytes"]})
    for r in counts.collect():
        tables.setdefault(r["table"], {"files": [], "rows": None})["rows"] = r["rows"]
    return json.dumps({"data_version": data_version, "exported_at": int(time.time()), "tables": tables},
                      sort_keys=True)


def manifest_files(spark: SparkSession, manifest_path: str) -> DataFrame:
    """(name, sha256) of every file listed in a manifest JSON document."""
    m = spark.read.option("multiLine", "true").json(manifest_path)
    t = m.select(F.explode(F.from_json(F.to_json("tables"),
                                       "map<string,struct<files:array<struct<name:string,sha256:string>>>>")))
    return t.select(F.explode("value.files").alias("f")).select("f.name", "f.sha256")


def manifest_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(action, name): ``UP`` for new or changed files, ``RM`` for files gone."""
    j = new.alias("n").join(old.alias("o"), F.col("n.name") == F.col("o.name"), "full_outer")
    up = F.col("n.name").isNotNull() & ~F.col("n.sha256").eqNullSafe(F.col("o.sha256"))
    rm = F.col("n.name").isNull()
    return j.where(up | rm).select(F.when(up, "UP").otherwise("RM").alias("action"),
                                   F.coalesce(F.col("n.name"), F.col("o.name")).alias("name"))


def sync_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(name, action): ``REUSE`` when a local file has the same name and sha256, else ``FETCH``."""
    j = remote.alias("r").join(local.alias("l"), F.col("r.name") == F.col("l.name"), "left")
    same = F.col("l.sha256").isNotNull() & (F.col("l.sha256") == F.col("r.sha256"))
    return j.select(F.col("r.name").alias("name"), F.when(same, "REUSE").otherwise("FETCH").alias("action"))


def write_documents(pieces: DataFrame, path: str) -> None:
    """Documents as text, in order over the files: one piece (cik, namespace, tag, text) a line, companies one after the
    other. Line ends between pieces are blanks to JSON. Pieces are dealt out by range, so a company may span files."""
    order = ["cik", "namespace", "tag"]
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.mode("errorifexists").text(path)


def append(df: DataFrame, path: str) -> None:
    """Bulk append (Parquet); Spark batches rows per task, no statement size limit."""
    df.write.mode("append").option("compression", "zstd").parquet(path)
