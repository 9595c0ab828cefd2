"""Near-duplicate embeddings: hierarchical navigable small-world graphs per shard, searched by every shard's label."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, connected_components, ship, spanning

SHARD = 16_384          # vectors of a graph
DEGREE = 16             # links of a node on the upper layers; twice as many on the lowest
BUILD_BEAM = 64
AUDIT = 48              # queries that an audit answers by brute force at a time
AUDIT_LINKS = 200       # true links after which an audit has seen enough
AUDIT_SHARE = 1 / 16    # share of a shard's queries after which it ends anyhow
RECALL = 0.995          # least share of true links that the audit must find


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``beam`` best nodes found for each query, best first; all queries step together.

    ``links`` (node, slot) holds neighbours, -1 where a slot is empty; ``entry`` (query, any number) node ids.
    """
    n_q, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n_q, len(x) + 1), bool)            # the last column stands for empty slots
    ids = np.full((n_q, beam), -1, np.int64)
    sims = np.full((n_q, beam), -np.inf, np.float32)
    done = np.ones((n_q, beam), bool)

    def merge(active, new):
        nonlocal ids, sims, done
        new = np.sort(new, axis=1)
        fresh = (new >= 0) & ~seen[active[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[active[:, None], np.where(fresh, new, len(x))] = True
        s = np.einsum("qd,qkd->qk", q[active], x[np.maximum(new, 0)])
        s[~fresh] = -np.inf
        s = np.concatenate([sims[active], s], 1)
        i = np.concatenate([ids[active], np.where(fresh, new, -1)], 1)
        d = np.concatenate([done[active], ~fresh], 1)
        top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        r = np.arange(len(active))[:, None]
        ids[active], sims[active], done[active] = i[r, top], s[r, top], d[r, top]

    merge(np.arange(n_q), entry)
    while True:
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            return ids, sims
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :4]         # the best nodes not yet expanded
        r = active[:, None]
        use = ~done[r, pick]
        done[r, pick] = True
        nodes = np.where(use, ids[r, pick], -1)
        merge(active, np.where((nodes >= 0)[:, :, None], links[np.maximum(nodes, 0)], -1).reshape(len(active), -1))


def _diverse(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> list[int]:
    """Neighbours by the usual heuristic: a candidate nearer to a chosen one than to the node waits; then the nearest."""
    near = x[ids] @ x[ids].T
    chosen: list[int] = []
    for k in range(len(ids)):
        if len(chosen) == degree:
            break
        if not chosen or near[k, chosen].max() < sims[k]:
            chosen.append(k)
    rest = [k for k in range(len(ids)) if k not in set(chosen)][:degree - len(chosen)]
    return ids[chosen + rest].tolist()


class Graph:
    """HNSW over unit vectors: layers from the lowest (all nodes) up; nodes come in the order of their levels."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")          # so every layer is a prefix
        self.x = np.ascontiguousarray(vectors[self.order], np.float32)
        self.sizes = [int((level >= k).sum()) for k in range(level.max() + 1)] if n else []
        self.layers = [np.full((m, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k, m in enumerate(self.sizes)]
        for k in range(len(self.layers) - 1, -1, -1):
            self._build(k)

    def _entries(self, q: np.ndarray, above: int) -> np.ndarray:
        """A start node for each query, by descent from the top to layer ``above``."""
        at = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.layers) - 1, above - 1, -1):
            at = beam_search(self.x[:self.sizes[k]], self.layers[k], q, at, 4)[0][:, :1]
        return at

    def _build(self, layer: int) -> None:
        links, n = self.layers[layer], self.sizes[layer]
        degree, begin = links.shape[1], 0
        while begin < n:
            end = min(n, max(begin * 2, 64), begin + 512)
            new = np.arange(begin, end)
            x = self.x[begin:end]
            found = np.empty((len(new), 0), np.int64)
            if begin:
                entry = self._entries(x, layer + 1) if layer + 1 < len(self.layers) else np.zeros((len(new), 1), np.int64)
                found = beam_search(self.x[:begin], links[:begin], x, np.minimum(entry, begin - 1), BUILD_BEAM)[0]
            peers = np.argsort(-(x @ x.T), axis=1, kind="stable")[:, :BUILD_BEAM // 2 + 1] + begin
            back: dict[int, list[int]] = {}
            for row, node in enumerate(new):
                near = np.unique(np.concatenate([found[row], peers[row]]))
                near = near[(near >= 0) & (near != node)]
                sims = self.x[near] @ self.x[node]
                best = np.argsort(-sims, kind="stable")[:BUILD_BEAM]
                chosen = _diverse(self.x, near[best], sims[best], degree // 2)
                links[node, :len(chosen)] = chosen
                for c in chosen:
                    back.setdefault(c, []).append(int(node))
            for node, more in back.items():
                own = links[node]
                near = np.unique(np.concatenate([own[own >= 0], more]))
                if len(near) > degree:
                    sims = self.x[near] @ self.x[node]
                    best = np.argsort(-sims, kind="stable")
                    near = np.array(_diverse(self.x, near[best], sims[best], degree))
                links[node] = -1
                links[node, :len(near)] = near
            begin = end

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self._entries(q, 1) if len(self.layers) > 1 else np.zeros((len(q), 1), np.int64)
        return beam_search(self.x, self.layers[0], q, entry, min(beam, len(self.x)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, order=self.order, **{f"layer{k}": a for k, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Graph":
        z = np.load(io.BytesIO(raw))
        g = cls.__new__(cls)
        g.x, g.order = z["x"], z["order"]
        g.layers = [z[f"layer{k}"] for k in range(len(z.files) - 2)]
        g.sizes = [len(a) for a in g.layers]
        return g


def links_of(graph: Graph, exact: np.ndarray, q: np.ndarray, threshold: float, beam: int = 64, same: bool = False) -> list[np.ndarray]:
    """For each query the graph's nodes (as rows of ``exact``) whose cosine is ``threshold`` or more.

    The beam of a query doubles as long as its worst node may still be a link. Audits compare queries with brute
    force, more of them until ``AUDIT_LINKS`` true links were seen (or ``AUDIT_SHARE`` of the queries); as long as the
    search finds less than ``RECALL`` of these, all beams start wider. ``same``: queries are the graph's own nodes, whose
    link with themselves doesn't count as seen.
    """
    q32, n = q.astype(np.float32), len(graph.x)
    order = np.random.default_rng(len(q)).permutation(len(q))
    audit, truth, seen = [], [], 0
    for s in range(0, len(q), AUDIT):
        part = order[s:s + AUDIT]
        hits = [np.flatnonzero(h) for h in q[part] @ exact.T >= threshold]
        audit.extend(part)
        truth.extend(hits)
        seen += sum(map(len, hits)) - (len(part) if same else 0)
        if seen >= AUDIT_LINKS or len(audit) >= AUDIT_SHARE * len(q):
            break
    while True:
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        todo, width = np.arange(len(q)), beam
        while len(todo):
            wide = []
            step = max(1, min(512, (8 << 20) // max(n, 1), (1 << 16) // width))
            for s in range(0, len(todo), step):
                part = todo[s:s + step]
                ids, sims = graph.search(q32[part], width)
                for row, k in enumerate(part):
                    near = ids[row][(ids[row] >= 0) & (sims[row] >= threshold - 1e-4)]
                    if len(near) == ids.shape[1] and ids.shape[1] < n:
                        wide.append(k)
                        continue
                    near = graph.order[near]
                    out[k] = near[exact[near] @ q[k] >= threshold]       # verified in double precision
            todo, width = np.array(wide, int), width * 2
        wanted = sum(map(len, truth)) - (len(audit) if same else 0)
        got = sum(len(np.intersect1d(out[a], t)) for a, t in zip(audit, truth)) - (len(audit) if same else 0)
        if got >= RECALL * wanted or beam >= n:
            return out
        beam *= 2


def _unit_vectors(batches):
    """Valid vectors as unit vectors of doubles, with a hash of their bits."""
    for b in batch_rows(batches):
        ids, labels, vectors, keys, dims = [], [], [], [], []
        for i, v, label in zip(*(c.to_pylist() for c in b.columns)):
            if v is None or label is None or any(e is None for e in v):
                continue
            a = np.array(v, np.float64)
            norm = np.sqrt(a @ a)
            if len(a) and np.isfinite(norm) and norm > 0:
                u = a / norm
                ids.append(i), labels.append(label), vectors.append(u.tobytes()), dims.append(len(a))
                keys.append(np.uint64(xxhash.xxh3_64_intdigest(a.tobytes())).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.int64()), pa.array(vectors, pa.binary())],
                                         names=["vec_id", "label", "dim", "key", "unit"])


def _stack(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _graphs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    first = pdf.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "graph": [Graph(_stack(pdf["unit"])).dump()],
                         "nodes": [pdf["node"].to_numpy().tobytes()], "copies": [pdf["copies"].to_numpy().tobytes()], "units": [b"".join(pdf["unit"])]})


def _searcher(threshold: float):
    def search(graphs: pd.DataFrame) -> pd.DataFrame:
        """One or two graphs of a label: the nodes of each are searched in the other, or in the graph itself."""
        graphs = graphs.sort_values("shard")
        sides = []
        for _, g in graphs.iterrows():
            nodes = np.frombuffer(g["nodes"], np.int64)
            sides.append((nodes, np.frombuffer(g["copies"], np.int64), np.frombuffer(g["units"], np.float64).reshape(len(nodes), -1), Graph.load(g["graph"])))
        a, b = sides[0], sides[-1]
        same = len(sides) == 1
        pairs = []
        for x, y, flip in ((a, b, False),) if same else ((a, b, False), (b, a, True)):
            found = links_of(y[3], y[2], x[2], threshold, same=same)
            i = np.repeat(np.arange(len(x[0])), [len(f) for f in found])
            j = np.concatenate(found).astype(np.int64) if len(i) else np.empty(0, np.int64)
            pairs.append(np.stack([j, i] if flip else [i, j]))
        i, j = np.concatenate(pairs, axis=1)
        if same:                                              # a pair counts once, whichever end found it
            i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        i, j = np.unique(np.stack([i, j]), axis=1) if len(i) else (i, j)
        nodes, copies = (a[0], a[1]) if same else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        j = j if same else j + len(a[0])
        n = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        star = dict(spanning(len(nodes), i, j))
        rows = [(nodes[k], int(n[k]), nodes[star.get(k, k)]) for k in np.flatnonzero(n).tolist()]
        return pd.DataFrame(rows, columns=["node", "links", "end"]).astype("int64")

    return search


def embedding_links(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row a vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label link if their cosine in double precision is ``threshold`` or more; ``n_links`` counts the
    other vectors linked with, a pair found from either end for both; ``component_id`` is the smallest vec_id reachable.

    1. Equal vectors of a label are one node with a number of copies, so a common vector is no hot key.
    2. Nodes of a label are dealt by hash into shards of about ``SHARD``; each shard's graph is built in one task and
       written as a row. Any two graphs of a label meet in a unit of their own, where the nodes of each are searched
       in the other, so a label of any size spreads; the work grows with nodes times shards.
    3. Links are verified in double precision; tasks return counts and spanning edges; components join the shards.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those of a null label link with
    nothing; so do vectors of different length. Repeated ids are vectors of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embedding_links")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("long"))
    valid = scratch.write(rows.mapInArrow(_unit_vectors, "vec_id bigint, label bigint, dim int, key bigint, unit binary"), "valid")
    node = F.xxhash64("label", "dim", "key")
    valid = valid.withColumn("node", node)
    nodes = scratch.write(valid.groupBy("node", "label", "dim").agg(F.first("unit").alias("unit"), F.count("*").alias("copies")), "nodes")
    size = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    nodes = nodes.join(size, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), "shards").cast("int"))
    graphs = scratch.write(nodes.groupBy("label", "dim", "shard").applyInPandas(
        _graphs, "label bigint, dim int, shard int, graph binary, nodes binary, copies binary, units binary"), "graphs")
    units = graphs.join(size, ["label", "dim"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    units = units.withColumn("low", F.least("shard", "other")).withColumn("high", F.greatest("shard", "other")).drop("shards", "other")
    found = scratch.write(units.groupBy("label", "dim", "low", "high").applyInPandas(_searcher(threshold), "node bigint, links bigint, end bigint"), "found")
    scratch.drop("graphs")

    classes = connected_components(found.select(F.col("node").alias("a"), F.col("end").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies").join(links, "node", "left").join(classes, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    per_row = scratch.write(valid.select("vec_id", "node").join(scratch.write(known, "known"), "node").select("vec_id", "n_links", "class"), "per_row")
    smallest = scratch.write(per_row.groupBy("class").agg(F.min("vec_id").alias("component_id")), "smallest")
    linked = per_row.join(smallest, "class").select("vec_id", "n_links", "component_id")
    # Every other row, by how often its id has occurred among the valid ones: repeated ids may differ in validity.
    total = rows.groupBy("vec_id").agg(F.count("*").alias("n")).join(
        valid.groupBy("vec_id").agg(F.count("*").alias("m")).withColumnRenamed("vec_id", "known_id"), F.col("vec_id").eqNullSafe(F.col("known_id")), "left")
    left = total.withColumn("rest", F.col("n") - F.coalesce("m", F.lit(0))).where("rest > 0")
    alone = left.select("vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest")))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
