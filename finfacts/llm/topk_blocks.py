"""Exact top-k search by integer inner product, block at a time.

Rows are put in order of their id and cut into shards, shards into blocks of consecutive rows. A block keeps its rows'
whole numbers (forward index) and, for each dimension (term), the greatest and the least of them. A query's bound for a
block is the sum over its terms of the most that the block's extremes allow. Within a shard a query takes the blocks in
order of falling bound, scores all rows of a block at once, and stops at the first block whose bound is below its kth
best score. It starts in its own shard, and takes that kth score along to the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, ship
from finfacts.llm.whitening import usable, whole_numbers

BLOCK = 512              # rows of a block
SHARD = 1 << 15          # rows of a shard, about
QUERIES = 512            # queries searched together, about
_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_EXACT = 1 << 53

_SHARD_SCHEMA = "shard int, ids binary, no_id binary, is_query binary, kind string, data binary"
_QUERY_SCHEMA = "row long, id binary, kind string, data binary, best binary, best_row binary"
_HIT_SCHEMA = "row long, query_id long, score long, hit_row long, vec_id long"


def _pack(m: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    top = int(np.abs(m).max(initial=0))
    kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
    return kind, m.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.int64)


def _shards(scale: float, dims: int):
    """One row per range partition: its rows in order, with their forward index."""
    def run(batches):
        parts = []
        for b in batch_rows(batches):
            ids = b.column(0)
            parts.append((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null(), bool), np.asarray(b.column(1), bool), whole_numbers(b.column(2), scale, dims)))
        if parts:
            ids, no_id, is_query, m = (np.concatenate(c) for c in zip(*parts))
            kind, data = _pack(m)
            yield pa.RecordBatch.from_arrays([
                pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, no_id, is_query)),
                pa.array([kind], pa.string()), pa.array([data], pa.binary())], names=["shard", "ids", "no_id", "is_query", "kind", "data"])
    return run


class ForwardIndex:
    """The blocks of one shard with each term's extremes; rows have numbers ``base`` and up."""

    def __init__(self, m: np.ndarray, base: int):
        self.m, self.base = m, base
        starts = np.arange(0, len(m), BLOCK)
        self.high = np.maximum.reduceat(m, starts, axis=0) if len(m) else m
        self.low = np.minimum.reduceat(m, starts, axis=0) if len(m) else m
        self.blocks = [m[s:s + BLOCK] for s in starts]
        self.top = int(np.abs(m).max(initial=0))

    def search(self, q: np.ndarray, own: np.ndarray, best: np.ndarray, row: np.ndarray) -> int:
        """Improve each query's ``best`` scores and their ``row`` numbers (both falling in rank) by this shard's rows.

        ``own`` is the number of the query's own row. Returns the number of (query, block) pairs scored.
        """
        exact = int(np.abs(q).max(initial=0)) * self.top * q.shape[1] < _EXACT
        dot = (lambda a, b: (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)) if exact else (lambda a, b: a @ b.T)
        if exact:
            bound = dot(np.maximum(q, 0), self.high) + dot(np.minimum(q, 0), self.low)
        else:                                           # bounds could pass 64 bits: every block is scored
            bound = np.full((len(q), len(self.blocks)), _LAST)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        scored = 0
        for r in range(len(self.blocks)):
            active = np.flatnonzero(bound[:, r] >= best[:, -1])         # an equal score may still have a smaller id
            if not len(active):
                break
            block = order[active, r]
            by = np.argsort(block, kind="stable")
            active, block = active[by], block[by]
            found = []
            for part in np.split(np.arange(len(active)), np.flatnonzero(np.diff(block)) + 1):
                who, at = active[part], block[part[0]]
                s = dot(q[who], self.blocks[at])
                n = self.base + at * BLOCK + np.arange(s.shape[1])
                hit = (s > best[who, -1:]) | ((s == best[who, -1:]) & (n[None, :] < row[who, -1:]))
                hit &= n[None, :] != own[who, None]
                i, j = np.nonzero(hit)
                found.append((who[i], s[i, j], n[j]))
                scored += len(who)
            _merge(best, row, *(np.concatenate(c) for c in zip(*found)))
        return scored


def _merge(best: np.ndarray, row: np.ndarray, who: np.ndarray, score: np.ndarray, n: np.ndarray) -> None:
    """Put found rows among the best of their queries; of equal scores the smaller row number is better."""
    if not len(who):
        return
    k, some = best.shape[1], np.unique(who)
    who = np.concatenate([np.repeat(some, k), who])
    score, n = np.concatenate([best[some].ravel(), score]), np.concatenate([row[some].ravel(), n])
    o = np.lexsort((n, -score, who)) if score.min() > _LEAST else np.lexsort((n, -np.maximum(score, _LEAST + 1), who))
    who, score, n = who[o], score[o], n[o]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
    at = first[:, None] + np.arange(k)
    best[some], row[some] = score[at], n[at]


def _hits(rows, ids, index: ForwardIndex, shard_ids, no_id, best, row) -> pa.RecordBatch:
    """The rows of this shard among the queries' best."""
    mine = (row >= index.base) & (row < index.base + len(index.m))
    i, j = np.nonzero(mine)
    at = row[i, j] - index.base
    return pa.RecordBatch.from_arrays([pa.array(rows[i], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(best[i, j], pa.int64()),
                                       pa.array(row[i, j], pa.int64()), pa.array(shard_ids[at], pa.int64(), mask=no_id[at])],
                                      names=["row", "query_id", "score", "hit_row", "vec_id"])


def _read_shard(r: dict, dims: int):
    m = _unpack(r["kind"], r["data"], dims)
    return ForwardIndex(m, r["shard"] << 32), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["no_id"], bool)


def _home(dims: int, k: int):
    """Each query against its own shard: a row per query with its best so far."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                index, ids, no_id = _read_shard(r, dims)
                at = np.flatnonzero(np.frombuffer(r["is_query"], bool))
                for s in range(0, len(at), QUERIES):
                    p = at[s:s + QUERIES]
                    q, own = index.m[p], index.base + p
                    best, row = np.full((len(p), k), _LEAST), np.full((len(p), k), _LAST)
                    index.search(q, own, best, row)
                    kind, _ = _pack(q)
                    # The ids of the best rows travel with them.
                    where = np.where(row == _LAST, 0, row - index.base)
                    known, missing = ids[where], no_id[where]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(own, pa.int64()), pa.array([x.tobytes() for x in np.concatenate([ids[p][:, None], known, missing.astype(np.int64)], axis=1)], pa.binary()),
                        pa.array([kind] * len(p), pa.string()), pa.array([x.astype(kind).tobytes() for x in q], pa.binary()),
                        pa.array([x.tobytes() for x in best], pa.binary()), pa.array([x.tobytes() for x in row], pa.binary())],
                        names=["row", "id", "kind", "data", "best", "best_row"])
    return run


def _home_hits(k: int):
    def run(batches):
        for b in batches:
            rows = np.asarray(b.column(0), np.int64)
            if not len(rows):
                continue
            ids = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, 2 * k + 1)
            best = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, k)
            row = np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64).reshape(-1, k)
            i, j = np.nonzero(row != _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(rows[i], pa.int64()), pa.array(ids[i, 0], pa.int64()), pa.array(best[i, j], pa.int64()),
                                              pa.array(row[i, j], pa.int64()), pa.array(ids[i, 1 + j], pa.int64(), mask=ids[i, 1 + k + j] != 0)],
                                             names=["row", "query_id", "score", "hit_row", "vec_id"])
    return run


def _bundle(k: int, dims: int):
    """About ``QUERIES`` queries as one row."""
    def run(key, table):
        d = table.to_pydict()
        q = np.concatenate([_unpack(kind, data, dims) for kind, data in zip(d["kind"], d["data"])])
        kind, data = _pack(q)
        ids = b"".join(x[:8] for x in d["id"])
        return pa.table({"row": pa.array([np.array(d["row"], np.int64).tobytes()], pa.binary()), "id": pa.array([ids], pa.binary()), "q_kind": [kind],
                         "q_data": pa.array([data], pa.binary()), "best": pa.array([b"".join(d["best"])], pa.binary()), "best_row": pa.array([b"".join(d["best_row"])], pa.binary())})
    return run


def _away(dims: int, k: int):
    """Bundles of queries against other shards, from the kth scores of their own."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if last != r["shard"]:
                    last, read = r["shard"], _read_shard(r, dims)
                index, ids, no_id = read
                rows, q = np.frombuffer(r["row"], np.int64), _unpack(r["q_kind"], r["q_data"], dims)
                best = np.frombuffer(r["best"], np.int64).reshape(-1, k).copy()
                row = np.frombuffer(r["best_row"], np.int64).reshape(-1, k).copy()
                other = rows >> 32 != r["shard"]               # the own shard has been searched
                best, row = best[other], row[other]
                if other.any():
                    index.search(q[other], rows[other], best, row)
                    yield _hits(rows[other], np.frombuffer(r["id"], np.int64)[other], index, ids, no_id, best, row)
    return run


def exact_top_k(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for every row where ``is_query``.

    Entries x become floor(scale x). Every usable row but the query's own is a candidate; equal scores are ordered by
    vec_id (null last). Exact whatever the bounds prune.

    Vectors that are null or hold null or non-finite entries take no part; shorter vectors count 0 in the missing
    entries. A repeated id stays a row, query and candidate of its own; a row with a null id is a candidate, but never a
    query. Fewer than ``k`` candidates give as many ranks. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "top_k")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), (F.coalesce(is_query, F.lit(False)) & F.col(f"`{vec_id}`").isNotNull()).alias("is_query"),
                     F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, 1)
    order = [F.asc_nulls_last("id"), F.col("tie")]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // SHARD)), *order).sortWithinPartitions(*order)
    shards = scratch.write(ranged.select("id", "is_query", "v").mapInArrow(_shards(float(scale), dims), _SHARD_SCHEMA), "shards")
    home = scratch.write(shards.mapInArrow(_home(dims, k), _QUERY_SCHEMA), "home")
    hits = home.select("row", "id", "best", "best_row").mapInArrow(_home_hits(k), _HIT_SCHEMA)
    n_shards, n_queries = shards.agg(F.max("shard")).first()[0] + 1, home.count()
    if n_shards > 1 and n_queries:
        group = F.pmod(F.xxhash64("row"), F.lit(-(-n_queries // QUERIES)))
        bundles = scratch.write(home.withColumn("bundle", group).groupBy("bundle").applyInArrow(
            _bundle(k, dims), "row binary, id binary, q_kind string, q_data binary, best binary, best_row binary"), "bundles")
        work = bundles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).join(shards.select("shard", "ids", "no_id", "kind", "data"), "shard")
        hits = hits.unionByName(work.mapInArrow(_away(dims, k), _HIT_SCHEMA))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "hit_row")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
