"""Register the tables of an exported manifest as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_tables(spark: SparkSession, manifest_path: str, base_dir: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """One DataFrame (and temp view) per manifest table, reading exactly the listed files.

    Only file names travel to the driver (one row per file), never data rows.
    """
    m = spark.read.option("multiLine", "true").json(manifest_path)
    t = m.select(F.explode(F.from_json(F.to_json("tables"), "map<string,struct<files:array<struct<name:string>>>>"))
                 .alias("table", "v"))
    files = t.select("table", F.explode("v.files.name").alias("name")).collect()
    by_table: dict[str, list[str]] = {}
    for r in files:
        by_table.setdefault(r["table"], []).append(f"{base_dir.rstrip('/')}/{r['table']}/{r['name']}")
    out = {}
    for table, paths in by_table.items():
        reader = spark.read
        if schemas and table in schemas:
            reader = reader.schema(schemas[table])
        df = reader.parquet(*paths)
        df.createOrReplaceTempView(table)
        out[table] = df
    return out
