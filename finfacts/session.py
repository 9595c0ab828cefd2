"""Spark session and checkpoint-directory helpers.

Every operator in the package is a pure ``DataFrame -> DataFrame`` function; the
only place that knows about cluster settings is this module.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults for settings that nobody has made: neither spark-submit, nor a file, nor a running session.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a planned sort-merge join to a broadcast join only when the
    # *measured* shuffle output of one side is below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.parquet.compression.codec": "zstd",
    # from_json keeps the fields that did parse; the facts explode relies on it.
    "spark.sql.json.enablePartialResults": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "finfacts") -> SparkSession:
    """The running session as it is, or a new one.

    A new session takes what spark-submit and its files set; ``_DEFAULTS`` fill in only what is unset, and a local
    master is taken only where none is named. The shuffle width is left alone unless asked for.
    """
    if SparkContext._active_spark_context is not None:
        spark = SparkSession.builder.getOrCreate()
        ensure_checkpoint_dir(spark)
        return spark
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    if submitted:
        SparkContext._ensure_initialized()
    given = dict(SparkConf().getAll())
    builder = SparkSession.builder.appName(app)
    if master or not ("spark.master" in given or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")):
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS') or '8'}]")
    for k, v in _DEFAULTS.items():
        if k not in given:
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if not submitted and "spark.driver.memory" not in given:
        builder = builder.config("spark.driver.memory", os.environ.get("FINFACTS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only with a local master, as in
    tests, may it be unset: then a private scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="finfacts-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files in the shared checkpoint folder, for a result that is read more than once."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
