"""Versioned store of tables in company buckets: a commit writes the touched buckets only and publishes all tables at once.

Layout under the store's folder::

    data/<attempt>/<table>/_bkt=<n>/*.parquet     written once, never changed
    versions/<version>.json                       {"buckets": 64, "tables": {table: {bucket: attempt}}}

A version lists, for every table and bucket, the attempt whose files hold it. A commit writes new files for the buckets
that its keys fall into, takes the other buckets over from the version before, and then creates one small file under a
name that must not exist yet. Readers see all tables of a version or none of it; an attempt that dies leaves files that
no version names, and two writers can't publish the same version.

The bucket is the numeric cik modulo the number of buckets, so a key's old and new rows share it. Buckets are files, not
tasks: a large one is split over several tasks and files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BUCKET = "_bkt"


def bucket_of(key: str | None, buckets: int) -> Column:
    """Numeric cik modulo ``buckets``; 0 for keys that are no number, and for tables without a key."""
    if key is None:
        return F.lit(0)
    return F.coalesce(F.pmod(F.col(key).try_cast("decimal(38,0)"), F.lit(buckets)), F.lit(0)).cast("int")


class Store:
    """The tables of one folder at its latest version, or an earlier one."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        names = self._names(f"{self.path}/versions")
        latest = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        self.version = latest if version is None else version
        self.state = json.loads(self._read(f"{self.path}/versions/{self.version}.json")) if self.version else {"buckets": buckets, "tables": {}}
        self.buckets = self.state["buckets"]

    # Files of a few KB, through the file system that the store lies on.
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read(self, path: str) -> str:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, version: int, text: str) -> None:
        """Create the version's file, whole and only if nobody has."""
        target, fs = self._fs(f"{self.path}/versions/{version}.json")
        part, _ = self._fs(f"{self.path}/versions/.{version}-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise RuntimeError(f"version {version} of {self.path} exists already")

    def has(self, name: str) -> bool:
        return name in self.state["tables"]

    def table(self, name: str, only: list[int] | None = None) -> DataFrame | None:
        """A table without its bucket column, None if the version has none; ``only`` limits it to some buckets."""
        entry = self.state["tables"].get(name)
        if entry is None:
            return None
        schema = T.StructType.fromJson(entry["schema"])
        paths = sorted(f"{self.path}/data/{attempt}/{name}/{BUCKET}={b}" for b, attempt in entry["files"].items() if only is None or int(b) in only)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def begin(self, version: int | None = None) -> "Commit":
        """Start a commit on top of this version; its number may be asked for, but not reused."""
        if version is not None and version <= self.version:
            raise ValueError(f"version {version} of {self.path} exists already (latest: {self.version})")
        return Commit(self, version or self.version + 1)


class Commit:
    """Tables written so far; ``publish`` makes them the next version."""

    def __init__(self, base: Store, version: int):
        self.base, self.version, self.attempt = base, version, f"v{version}-{uuid.uuid4().hex[:12]}"
        self.state = json.loads(json.dumps(base.state))
        self.rewritten: dict[str, list[int]] = {}

    def touched(self, keys: DataFrame, key: str = "cik") -> list[int]:
        """The buckets that hold the keys (one number a bucket)."""
        return sorted(r["b"] for r in keys.select(bucket_of(key, self.base.buckets).alias("b")).distinct().collect())

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Rows that several steps of this commit read, written once; no version lists them."""
        path = f"{self.base.path}/data/{self.attempt}/_{name}"
        df.write.parquet(path)
        return self.base.spark.read.schema(df.schema).parquet(path)

    def _write(self, name: str, df: DataFrame, buckets: list[int] | None, key: str | None) -> None:
        columns = [c for c in df.columns if c != BUCKET]
        path = f"{self.base.path}/data/{self.attempt}/{name}"
        # One bucket a task, large ones over several; rows sorted so that readers skip row groups by key.
        (df.select(*columns, bucket_of(key, self.base.buckets).alias(BUCKET)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *([key] if key else []))
         .write.option("compression", "zstd").partitionBy(BUCKET).parquet(path))
        entry = self.state["tables"].setdefault(name, {"files": {}})
        written = {n.split("=")[1] for n in self.base._names(path) if n.startswith(f"{BUCKET}=")}
        for b in (list(entry["files"]) if buckets is None else map(str, buckets)):
            entry["files"].pop(b, None)
        entry["files"].update(dict.fromkeys(written, self.attempt))
        entry["schema"] = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.select(*columns).schema]).jsonValue()
        self.rewritten[name] = sorted(map(int, written)) if buckets is None else list(buckets)

    def overwrite(self, name: str, df: DataFrame, key: str | None = "cik") -> None:
        """The whole table anew; small tables may have no key."""
        self._write(name, df, None, key)

    def replace(self, name: str, new: DataFrame, changed: DataFrame, key: list[str] | str = "cik") -> None:
        """Rows of the ``changed`` keys go, ``new`` rows come; only buckets of changed keys are read and written.

        ``key`` starts with the bucketed column; more columns narrow what goes (say a namespace). New rows must belong
        to changed keys.
        """
        keys = [key] if isinstance(key, str) else list(key)
        buckets = self.touched(changed, keys[0])
        old = self.base.table(name, buckets)
        rows = new if old is None else old.join(changed.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))
        self._write(name, rows, buckets, keys[0])

    def table(self, name: str) -> DataFrame | None:
        """A table as this commit will publish it."""
        view = Store.__new__(Store)
        view.spark, view.path, view.version, view.state, view.buckets = self.base.spark, self.base.path, self.version, self.state, self.base.buckets
        return view.table(name)

    def publish(self) -> Store:
        self.base._publish(self.version, json.dumps(self.state, sort_keys=True))
        return Store(self.base.spark, self.base.path)
