"""Continuous refresh of the facts store from landed company files.

New or rewritten ``CIK*.json`` files arrive in a landing folder. Each micro-batch is applied like a delta build
(``jobs.apply_company_files``): hashes compared with those last seen, only new or changed companies exploded, only the
buckets that they fall into rewritten, all tables published as one version. ``foreachBatch`` is at-least-once; a
replayed batch finds equal hashes and publishes nothing, so the store stays exactly-once in effect. A batch that dies
leaves files that no version names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.functions.ids import normalize_cik
from finfacts.plans.jobs import apply_company_files
from finfacts.store import Store

FACTS_NAME = r"CIK(\d+)\.json$"


def current_version(spark: SparkSession, store: str) -> int | None:
    return Store(spark, store).version or None


def read_store(spark: SparkSession, store: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(facts, companies) of the latest version."""
    s = Store(spark, store)
    return s.table("facts"), s.table("companies")


def apply_batch(spark: SparkSession, files: DataFrame, store: str, epoch: int, rules: DataFrame | None = None, std_rules: DataFrame | None = None,
                definitions: DataFrame | None = None) -> int:
    """files: (name, payload[, mtime]). Of several deliveries of a company the newest counts, by modification
    time, then hash. Returns the number of companies changed (0 = no-op).

    With ``rules`` (statement, tag) the tables that follow from facts are maintained too, with ``std_rules`` also
    statements; tables that the store lacks so far are built from all its facts. ``epoch`` orders the loads.
    """
    incoming = (files.where(F.col("name").rlike(FACTS_NAME))
                .select(normalize_cik(F.regexp_extract("name", FACTS_NAME, 1)).alias("cik"), "payload",
                        F.sha2(F.encode("payload", "UTF-8"), 256).alias("h"),
                        (F.col("mtime") if "mtime" in files.columns else F.lit(None)).cast("timestamp").alias("mtime")))
    newest = incoming.groupBy("cik").agg(F.max(F.struct("mtime", "h")).alias("newest"))
    incoming = (incoming.join(newest, "cik").where(F.struct("mtime", "h").eqNullSafe(F.col("newest"))).dropDuplicates(["cik"])
                .select("cik", "payload", "h", F.lit(int(epoch)).cast("long").alias("load_seq")))
    return apply_company_files(Store(spark, store), incoming, rules, std_rules, definitions)


def start_refresh(spark: SparkSession, landing: str, store: str, checkpoint: str, trigger_once: bool = True,
                  rules: DataFrame | None = None, std_rules: DataFrame | None = None, definitions: DataFrame | None = None):
    """Start the file-source stream; returns the StreamingQuery (``availableNow`` by default)."""
    # Each delivery lands in its own folder (a rewritten file keeps its name, and
    # the file source tracks files by path), hence the recursive lookup.
    stream = (spark.readStream.schema("value string").option("wholetext", "true")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", "CIK*.json").text(landing)
              .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"),
                      F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("mtime")))

    def each(batch: DataFrame, epoch: int) -> None:
        apply_batch(batch.sparkSession, batch, store, epoch + 1, rules, std_rules, definitions)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="1 minute")
    return w.start()
