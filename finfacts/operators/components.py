"""Connected components of an undirected graph, by smallest neighbour labels and pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.session import scratch_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node of an edge.

    Each round a node takes the smallest label around it, then that label's own label, so long chains shrink by half.
    Rounds are written to the checkpoint folder: the plan stays short and a lost executor costs one round. A node of
    many edges is one partial aggregation, never a group in one task.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, f"components-{uuid.uuid4().hex[:12]}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    e = edges.select("a", "b").where("a is not null and b is not null")
    both = written(e.union(e.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "0")
    i = 0
    while True:
        i += 1
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = label.join(near, "node").select("node", "component", F.least("component", "m").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("low2"))
        nxt = written(low.join(jump, "low").select("node", F.col("low2").alias("component"), (F.col("low2") != F.col("component")).alias("moved")), str(i))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", "component")
        label = nxt.drop("moved")
