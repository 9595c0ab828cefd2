"""Join policy: no broadcast hints.

Catalyst broadcasts a side whose size it knows to be small (literal tables, limits, small files), AQE one whose measured
shuffle output is; any other join sorts and merges, with skewed partitions split. A row count here would be a job at
planning time, and rows aren't bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A table of literal rows as a local relation, whose size Catalyst knows (rows given as Python objects would be
    an RDD of unknown size, and its joins would shuffle)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [()] * len(schema)
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema)
