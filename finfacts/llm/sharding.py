"""Contiguous shards of near-equal byte size from global prefix sums (law ``bytes``)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, ship, without

_ADDED = ("size", "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _prefix(batches):
    """Per range partition: bytes and rows before each row."""
    part, before, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column(b.schema.get_field_index("size"))
        end = pc.add(pc.cumulative_sum(size), before)
        start = pc.subtract(end, size)
        cols = [*b.columns, pa.array([part] * b.num_rows, pa.int32()), start,
                pa.array(range(rows, rows + b.num_rows), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "__part", "__before", "__row"])
        if b.num_rows:
            before, rows = end[-1].as_py(), rows + b.num_rows


def shard_by_bytes(df: DataFrame, order_by: list[str], size: Column, n_shards: int = 8) -> DataFrame:
    """Every row of ``df`` with ``size``, ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in its shard).

    Rows are range-partitioned by ``order_by`` (rows that tie there are split by a row number, so no key is too
    hot), each partition reports its bytes and rows, and the running totals of these few reports turn local prefix
    sums into global ones. A row goes to the shard whose equal slice of all bytes holds its middle byte: shards are
    contiguous in the order and differ from the target by less than one row. The driver sees one report a partition.

    Nulls in ``order_by`` sort first; sizes must be non-negative longs (null counts 0). Repeated rows stay separate
    rows. An empty table gives no rows; where all sizes are 0, shard 0 takes all. Input columns named ``size``,
    ``shard`` or ``slot`` are replaced.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "shard_by_bytes")
    keys = [F.col(f"`{c}`") for c in order_by]
    rows = df.select("*", F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
                     F.monotonically_increasing_id().alias("__tie"))
    rows = without(rows, *(c for c in _ADDED if c not in order_by)).withColumnRenamed("__size", "size")
    ranged = rows.repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, F.col("__tie")).drop("__tie")
    schema = ranged.schema.simpleString()[7:-1] + ",__part:int,__before:bigint,__row:bigint"
    placed = scratch.write(ranged.mapInArrow(_prefix, schema), "prefix")

    reports = placed.groupBy("__part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    offsets, total, count = [], 0, 0
    for r in sorted(reports, key=lambda r: r["__part"]):
        offsets.append((r["__part"], total, count))
        total, count = total + r["b"], count + r["n"]
    starts = spark.createDataFrame(offsets, "__part int, __bytes0 long, __rows0 long")
    middle = F.expr("cast(2 * (__bytes0 + __before) + size as decimal(38,0))")
    shard = (F.least(F.floor(middle * F.lit(n_shards) / F.lit(2 * total)), F.lit(n_shards - 1)) if total
             else F.lit(0)).cast("int")
    out = placed.join(F.broadcast(starts), "__part").withColumn("shard", shard).withColumn(
        "__row", F.col("__rows0") + F.col("__row"))
    first = out.groupBy("shard").agg(F.min("__row").alias("__first"))       # n_shards rows
    out = out.join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__tie"], "shard", "slot")
