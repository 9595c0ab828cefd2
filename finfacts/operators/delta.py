"""Change detection and keyed replacement for incremental loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.store import bucket_of


def classify_changes(new: DataFrame, old: DataFrame, key: str = "cik", h: str = "h") -> DataFrame:
    """(key, status) for every incoming key: ``new``, ``changed`` or ``unchanged``."""
    o = old.select(F.col(key), F.col(h).alias("_old"))
    j = new.select(key, h).join(o, key, "left")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col(h), "changed").otherwise("unchanged")
    return j.select(key, status.alias("status"))


def changed_keys(classified: DataFrame, key: str = "cik") -> DataFrame:
    return classified.where(F.col("status") != "unchanged").select(key)


def check_change_limit(keys: DataFrame, limit: int | None = None, force: bool = False) -> int:
    """Number of changed keys. With ``limit``, an operator's safety stop: refuse a delta of more keys unless forced."""
    n = keys.count()
    if limit is not None and n > limit and not force:
        raise RuntimeError(f"more than {limit} changed keys; rerun with force to apply")
    return n


def replace_by_key(old: DataFrame, new: DataFrame, key="cik", changed: DataFrame | None = None) -> DataFrame:
    """Delete every row whose key occurs in ``changed`` (by default the keys of ``new``), then append ``new``.

    With ``changed``, a changed key that has no new rows loses its old ones. Other keys keep their rows. ``key``
    may be a list — e.g. (cik, namespace) replaces only a company's ``dei`` rows.
    A hot key on the ``old`` side is split by AQE's skew-join handling.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return old.join((new if changed is None else changed).select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def touched_buckets(table: DataFrame, changed: DataFrame, buckets: int, key: str = "cik") -> DataFrame:
    """(bucket, changed, rows_replaced, rows_kept) of the buckets that replacing the ``changed`` keys rewrites."""
    c = changed.select(key).distinct().withColumn("_changed", F.lit(True))
    rows = table.select(key, bucket_of(key, buckets).alias("bucket")).join(c, key, "left")
    hit = F.col("_changed").isNotNull()
    out = rows.groupBy("bucket").agg(F.count_distinct(F.when(hit, F.col(key))).alias("changed"), F.count_if(hit).alias("rows_replaced"),
                                     F.count_if(~hit).alias("rows_kept"))
    return out.where("rows_replaced > 0")


def full_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace everything, but keep ``old`` when ``new`` is empty (a failed download
    must not wipe the table)."""
    return new if new.limit(1).count() else old


def upsert_last(*versions: DataFrame, key, order: str = "load_seq") -> DataFrame:
    """Insert-or-update: per key the row of the highest ``order`` wins.
    Aggregation (partial per task), not a window, so a hot key is reduced early."""
    keys = [key] if isinstance(key, str) else list(key)
    u = versions[0]
    for v in versions[1:]:
        u = u.unionByName(v)
    payload = [c for c in u.columns if c not in keys and c != order]
    w = u.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_w"))
    return w.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in payload])


def needs_full_rebuild(processed_rows: int, standardized_rows: int) -> bool:
    """Recovery rule: companies processed but nothing standardized -> rebuild all."""
    return processed_rows > 0 and standardized_rows == 0
