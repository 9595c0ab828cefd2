"""Helpers shared by the training-data operators: tables, intermediate tables, code shipping, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_finfacts_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):          # already imported from a shipped zip
        return
    path = os.path.join(tempfile.mkdtemp(prefix="finfacts-code-"), "finfacts.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._finfacts_shipped = True


_caches: dict[str, Callable[[], None]] = {}


def cache_of(owner: str, clear: Callable[[], None]) -> None:
    """Register how to empty a cache that a worker keeps between tasks."""
    _caches[owner] = clear


def only_cache_of(*owners: str) -> None:
    """Empty the caches of other stages, as Spark reuses Python workers. Called at the start of a stage's tasks."""
    for name, clear in _caches.items():
        if name not in owners:
            clear()


class Scratch:
    """Intermediate Parquet tables in the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage, so a lost executor costs its running tasks only. ``drop`` removes tables
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, f"{name}-{uuid.uuid4().hex[:12]}", {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}/{step}")
        df.write.mode("errorifexists").parquet(path)
        self._paths[step] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, step: str) -> str:
        """A folder for files that tasks write themselves."""
        return scratch_path(self.spark, f"{self.name}/{step}")

    def drop(self, *steps: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for step in steps:
            p = jvm.org.apache.hadoop.fs.Path(self._paths.pop(step))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def batch_rows(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about ``max_bytes`` (a single larger row stays whole)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of stars that connect what the links (i, j) among n nodes connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return [(k, int(x)) for k, x in enumerate(label) if k != x]
        label = new


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end ``u`` has one edge and is nobody's smaller end ``v``: then v is a component's smallest node."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))
    ends = ends.groupBy("n").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return ends.where("larger > 1 or larger = 1 and smaller = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node id reachable over undirected ``edges`` (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the edges are stars, which is asked
    before each round, so that edges that are stars already cost none. A node of high degree costs one partial
    aggregation (minimum of its neighbours) and one join that AQE may split, as both sides are written tables, never a
    group in one task. Nodes without an edge don't occur in the result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur = scratch.write(e, f"{tag}_0")
    i = 0
    while not _are_stars(cur):
        i += 1
        # Large star: every larger neighbour of u is linked to the smallest node around u.
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{tag}_{i}a")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mid = scratch.write(large, f"{tag}_{i}l")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = scratch.write(mid.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_{i}b")
        small = (mid.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        nxt = scratch.write(small, f"{tag}_{i}")
        scratch.drop(f"{tag}_{i}a", f"{tag}_{i}b", f"{tag}_{i}l", f"{tag}_{i - 1}")
        cur = nxt
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
