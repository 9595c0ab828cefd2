"""Finding on op9_embedding_links: rounds of components that the result doesn't need, and unbounded batches."""
import random

import numpy as np

from finfacts.llm import common, hnsw_dedup
from finfacts.llm.common import Scratch


class Counting(Scratch):
    def __init__(self, *args):
        super().__init__(*args)
        self.steps = []

    def write(self, df, step):
        self.steps.append(step)
        return super().write(df, step)


def _components(edges):
    of = {}
    for a, b in edges:
        if a != b:
            of.setdefault(a, {a}), of.setdefault(b, {b})
            if of[a] is not of[b]:
                both = of[a] | of[b]
                of.update(dict.fromkeys(both, both))
    return {n: min(c) for n, c in of.items()}


def _run(spark, edges):
    scratch = Counting(spark, "components")
    out = common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()
    assert len(out) == len({r["node"] for r in out})
    return {r["node"]: r["component"] for r in out}, scratch.steps


def test_edges_that_are_stars_need_no_round(spark):
    edges = [(k, 10 * (k // 10)) for k in range(-50, 50)] + [(3, 0), (0, 3), (7, 7)]
    got, steps = _run(spark, edges)
    assert got == _components(edges) and steps == ["cc_0"]


def test_other_edges_are_joined_as_before(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(40)]
    two_centres = [(200, 100), (200, 101), (300, 301), (301, 302)]
    mixed = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(130)]
    edges = path + two_centres + mixed
    got, steps = _run(spark, edges)
    assert got == _components(edges) and len(steps) > 1
    assert _run(spark, []) == ({}, ["cc_0"])


def test_vectors_are_parsed_in_bounded_batches(monkeypatch):
    import pyarrow as pa
    n, dim = 4096, 1024
    one = pa.array(np.ones(n * dim) + np.repeat(np.arange(n), dim))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), one), pa.array([0] * n, pa.int64())], names=["vec_id", "embedding", "label"])
    out = list(hnsw_dedup._unit_vectors([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in out) * dim * 8 <= 8 << 20
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(n))
