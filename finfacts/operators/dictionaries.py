"""Dictionaries that grow across loads (L2, L3): keys found once, ids that never clash, first texts kept.

An id is a 64-bit hash of its key, so encoding is a projection. Should two keys of a dictionary hash alike, the later
one gets the hash of the key and a number (1, 2, ...) instead; ``salt`` tells which. Encoding then looks up the few
keys with a salt and hashes the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finfacts.session import scratch_path

Hash = Callable[[Sequence[str], int], Column]
_NEVER = 9223372036854775807


def key_hash(cols: Sequence[str], salt: int) -> Column:
    return F.xxhash64(*cols, *([F.lit(salt)] if salt else []))


def dictionary_delta(stored: DataFrame | None, rows: DataFrame, cols: Sequence[str], attrs: Sequence[str], order: str, hash_of: Hash = key_hash) -> DataFrame:
    """``stored`` (id, salt, *cols, *attrs) with the keys of ``rows`` that it lacks.

    A new key takes its attributes from its first row by ``order`` (null last); stored keys keep theirs. Ids are unique:
    of keys that hash alike the stored one, else the smallest, keeps the plain hash. Only keys go through a shuffle, and
    a clash costs another round for the keys that lost it.
    """
    cols, attrs = list(cols), list(attrs)
    seq = F.coalesce(F.col(order).cast("long"), F.lit(_NEVER))
    first = [F.min_by(a, seq).alias(a) for a in attrs]
    keys = rows.groupBy(*cols).agg(*first) if first else rows.select(*cols).distinct()
    if stored is not None:
        keys = keys.join(stored.select(*cols), cols, "left_anti")
    settled, waiting, salt = stored, keys, 0
    while True:
        hashed = waiting.select(hash_of(cols, salt).alias("id"), F.lit(salt).alias("salt"), *cols, *attrs)
        ranked = hashed.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*cols)))
        if settled is not None:
            ranked = ranked.join(settled.select("id", F.lit(True).alias("_taken")), "id", "left")
        else:
            ranked = ranked.withColumn("_taken", F.lit(None).cast("boolean"))
        lost = F.col("_taken").isNotNull() | (F.col("_n") > 1)
        won = ranked.where(~lost).drop("_n", "_taken")
        settled = won if settled is None else settled.unionByName(won.select(*settled.columns))
        losers = ranked.where(lost)
        if losers.isEmpty():
            return settled
        # A clash: both tables are written, so that the plan doesn't grow with the rounds.
        base = scratch_path(rows.sparkSession, f"dictionary-{uuid.uuid4().hex[:12]}")
        losers.select(*cols, *attrs).write.parquet(f"{base}/waiting")
        settled.write.parquet(f"{base}/settled")
        waiting, settled, salt = rows.sparkSession.read.parquet(f"{base}/waiting"), rows.sparkSession.read.parquet(f"{base}/settled"), salt + 1


def encode_key(rows: DataFrame, dictionary: DataFrame, cols: Sequence[str], id_name: str, hash_of: Hash = key_hash) -> DataFrame:
    """``rows`` with ``id_name`` in place of ``cols``; null where the last of them is null."""
    cols = list(cols)
    salted = dictionary.where("salt > 0").select(F.col("id").alias("_salted"), *cols)       # clashes: hardly any
    out = rows.join(salted, cols, "left").withColumn(id_name, F.when(F.col(cols[-1]).isNotNull(), F.coalesce("_salted", hash_of(cols, 0))))
    return out.drop("_salted", *cols)


def decode_key(rows: DataFrame, dictionary: DataFrame, cols: Sequence[str], id_name: str, spread: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``cols`` in place of ``id_name``; a null id gives nulls.

    Rows without an id match nothing; ``spread`` names columns whose hash is a second join key for them, so that they
    don't meet in one task.
    """
    d = dictionary.select(F.col("id").alias(id_name), *cols)
    if not spread:
        return rows.join(d, id_name, "left").drop(id_name)
    r = rows.withColumn("_spread", F.coalesce(F.col(id_name), F.xxhash64(*spread)))
    return r.join(d.withColumn("_spread", F.col(id_name)), [id_name, "_spread"], "left").drop(id_name, "_spread")
