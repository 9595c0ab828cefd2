"""Payload helpers: canonical JSON and its hash (column functions), gzip.

Spark has no gzip function, so gzip is an Arrow-batched pandas UDF over the canonical text.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def canonical_json(col) -> Column:
    """JSON text -> canonical form; null if invalid (also if an object repeats a key).

    Keys are sorted, blanks are gone, and equal numbers read alike: ``12.50`` is ``12.5``, ``12.0`` is ``12``.
    """
    return F.to_json(F.try_parse_json(col))


def canonical_json_sha256(col) -> Column:
    """SHA-256 (hex) of the canonical JSON form: key order and spacing do not change it."""
    return F.sha2(F.encode(canonical_json(col), "UTF-8"), 256)


def gzip_canonical_json(col) -> Column:
    """Canonical JSON compressed with gzip (level 6, mtime 0, so equal input -> equal bytes)."""
    @pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else gzip.compress(x.encode("utf-8"), compresslevel=6, mtime=0))
    return f(canonical_json(col))


def gunzip_text(col) -> Column:
    """gzip bytes -> UTF-8 text; undecodable payloads -> null."""
    @pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        def one(b):
            if b is None:
                return None
            try:
                return gzip.decompress(bytes(b)).decode("utf-8")
            except (OSError, EOFError, UnicodeDecodeError):
                return None
        return s.map(one)
    return f(col)
