"""Collocations, whitening and top-k search against brute force, and on awkward rows."""
import collections
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from finfacts.llm import phrases, topk_blocks, whitening
from finfacts.llm.common import Scratch

NAN, INF = float("nan"), float("inf")


# ---- phrases

def _pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", low)]


def _brute(rows, min_count, cover, top):
    """Collocations by counting every sequence of one to four words."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {g: n for g, n in c.items() if len(g) > 1 and n >= min_count}
        covered = set()
        for g, n in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    if 100 * n >= cover * cand[g[i:i + k]]:
                        covered.add(g[i:i + k])
        best = []
        for g, a in cand.items():
            if g not in covered:
                s, k = min((2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
                best.append((-s, -a, " ".join(g).encode(), a, c[g[:k]], c[g[k:]], s))
        for i, (_, _, p, a, l, r, s) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, p.decode(), a, l, r, total[lang], s))
    return sorted(out)


def _texts(n, seed):
    r = random.Random(seed)
    words = ["a", "B", "c", "ü", " d", "e%", "f_", "\\", "g"]
    fixed = ["the quick brown fox jumps over the lazy dog", "x y x y x y x y", "new york city hall"]
    out = []
    for _ in range(n):
        t = "".join(r.choice([r.choice(words), r.choice(words), r.choice(fixed)]) + r.choice([" ", "\t ", ", ", ".", "\n", "  "]) for _ in range(r.randrange(40)))
        out.append((r.choice(["en", "de", None, ""]), t))
    return out


AWKWARD = [("en", None), ("en", ""), ("en", " \t\n"), (None, "the quick brown fox"), ("en", "the quick brown fox jumps " * 4000), ("en", "a b"), ("en", "a b")]


@pytest.mark.parametrize("min_count,cover,top,chunk,bits", [(2, 80, 10, 1 << 21, 27), (5, 50, 1000, 40, 12), (3, 101, 50, 300, 6)])
def test_collocations_against_counting(spark, monkeypatch, min_count, cover, top, chunk, bits):
    """Also with chunks of a few words, and with a filter so small that it lets nearly everything through."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    rows = _texts(150, min_count) + AWKWARD
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).select("*", *[F.lit("x").alias(c) for c in ("n", "a", "rank", "phrase", "score", "k")])
    got = phrases.collocations(df, "text", "lang", min_count, cover, top, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _brute(rows, min_count, cover, top)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, min_count=10 ** 6).count() == 0


def test_paths_join_equal_edges_and_break_at_branches_and_rings(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 3)
    chain = "a b c d e f g h i j k".split()
    edges = [("en", " ".join(chain[i:i + 4]), 7) for i in range(len(chain) - 3)]
    edges += [("en", "h i j z", 7)] + [("de", " ".join(w), 5) for w in ("p q r p".split(), "q r p q".split(), "r p q r".split())] + [("fr", "a b c d", 7), ("fr", "b c d e", 8)]
    df = spark.createDataFrame(edges, "lang string, phrase string, f long")
    got = phrases.compact_paths(df, Scratch(spark, "test_paths")).collect()
    spans = sorted((r["lang"], " ".join(r["words"]), r["f"]) for r in got)
    # "h i j" has two edges out, so the path ends there; segments of three edges overlap in three words.
    assert [s for s in spans if s[0] == "en"] == [("en", "a b c d e f", 7), ("en", "d e f g h i", 7), ("en", "g h i j", 7), ("en", "h i j k", 7), ("en", "h i j z", 7)]
    assert [s[1:] for s in spans if s[0] == "de"] == [("p q r p", 5), ("q r p q", 5), ("r p q r", 5)]       # a ring: edges alone
    assert [s[1:] for s in spans if s[0] == "fr"] == [("a b c d", 7), ("b c d e", 8)]                       # unequal weights


# ---- whitening

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", F.lit("x").alias("whitened"), F.lit(1).alias("component"), F.lit(2).alias("n"))


def _numpy_whiten(v, k):
    x = np.floor(1024 * np.array(v, np.float32).astype(float)) + 100000
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum(int(e) ** 2 for e in (n * r - s))) for r in x]
    c = x - s / n
    cov = c.T @ c / n
    w, u = np.linalg.eigh(cov)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    return dev, c @ u / np.sqrt(w), w / np.trace(cov)


def test_whitening_against_numpy_and_awkward_rows(spark):
    r = np.random.default_rng(1)
    good = r.normal(size=(300, 6)) * [5, 3, 2, 1, .5, .1]
    good[7] = good[8]                                                   # repeated rows
    rows = [(i if i != 9 else None, [float(x) for x in v]) for i, v in enumerate(good)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [NAN] * 6), (903, [INF] + [0.0] * 5)]
    out = whitening.whiten(_vectors(spark, rows + bad).repartition(4), k=8)
    got = out.toPandas()
    assert len(got) == 300 * 6 and set(got["n"]) == {300} and got["identity_error"].iloc[0] < 1e-9
    dev, white, share = _numpy_whiten(good, 6)
    got = got.sort_values(["vec_id", "component"])
    w = got["whitened"].to_numpy().reshape(300, 6)
    order = [i for i in range(300) if i != 9] + [9]                     # null id last
    assert got["deviation"].to_numpy().reshape(300, 6)[:, 0].tolist() == [dev[i] for i in order]
    sign = np.sign((w * white[order]).sum(axis=0))
    assert np.abs(w - white[order] * sign).max() < 1e-9
    assert np.abs(got["explained"].to_numpy().reshape(300, 6)[0] - share).max() < 1e-12
    empty = _vectors(spark, bad)
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty).columns == out.columns
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0               # no variance
    flat = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [2.0]), (3, [])])).toPandas()                 # short vectors: zeros
    assert sorted(set(flat["component"])) == [1, 2] and len(flat) == 6


def test_equal_eigenvalues_and_rank_deficiency(spark):
    """A cube's corners have three equal eigenvalues; a repeated column has one of zero."""
    corners = [(i, [float(a), float(b), float(c), float(c)]) for i, (a, b, c) in enumerate(itertools.product([-1, 1], repeat=3))]
    got = whitening.whiten(_vectors(spark, corners)).toPandas()
    assert sorted(set(got["component"])) == [1, 2, 3] and got["identity_error"].iloc[0] < 1e-12
    assert got.groupby("component")["explained"].first().round(12).tolist() == [0.5, 0.25, 0.25]


def test_exact_algebra():
    r = random.Random(3)
    a = [[r.randrange(-9, 9) for _ in range(5)] for _ in range(7)]
    m = [[sum(a[k][i] * a[k][j] for k in range(7)) for j in range(5)] for i in range(5)]
    p = 2 ** 31 - 1
    want = [int(round(c)) % p for c in np.poly(np.array(m, float))][::-1]
    assert whitening.charpoly_mod(m, p) == want
    assert next(whitening.primes_below(100)) == 97
    e = [1, 10, 31, 30, 0]                                              # roots 2, 3, 5 and 0
    assert [round(float(x), 12) for x in whitening.largest_roots(e, 4)] == [5.0, 3.0, 2.0]
    double = [1, 6, 9, 0]                                               # 3 twice
    assert [float(x) for x in whitening.largest_roots(double, 3)] == [pytest.approx(3.0, abs=1e-15)] * 2
    big = np.array([[2 ** 40 + 1, -(2 ** 41)], [-3, 2 ** 45]], np.int64)
    want = [[sum(int(big[k, i]) * int(big[k, j]) for k in range(2)) for j in range(2)] for i in range(2)]
    assert whitening._products(big).tolist() == want
    assert whitening.null_vectors([[2, 0], [0, 5]], [Fraction(5)]) == [[0.0, 1.0]] or abs(whitening.null_vectors([[2, 0], [0, 5]], [Fraction(5)])[0][1] - 1) < 1e-15


def test_whitening_of_the_given_table(spark):
    from finfacts.llm import queries
    got = queries.QUERIES["op11_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    dev, white, share = _numpy_whiten(np.stack(e["embedding"].values), 8)
    w = got["whitened"].to_numpy().reshape(-1, 8)
    assert got["deviation"].to_numpy()[::8].tolist() == dev and np.abs(w - white * np.sign((w * white).sum(axis=0))).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:8] / share - 1).max() < 1e-9 and got["identity_error"].max() < 1e-9


# ---- top-k search

def _top(rows, is_query, k):
    x = {i: [int(np.floor(256.0 * float(np.float32(c)))) for c in v] for i, (_, v) in enumerate(rows)}
    out = []
    for i, (q, _) in enumerate(rows):
        if q is not None and is_query(q):
            s = sorted((-sum(a * b for a, b in zip(x[i], x[j])), rows[j][0] is None, rows[j][0] or 0) for j in x if j != i)[:k]
            out += [(q, n, None if none else d, -score) for n, (score, none, d) in enumerate(s, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,bundle", [(1 << 15, 512, 512), (40, 7, 3)])
def test_top_k_against_brute_force(spark, monkeypatch, shard, block, bundle):
    monkeypatch.setattr(topk_blocks, "SHARD", shard)
    monkeypatch.setattr(topk_blocks, "BLOCK", block)
    monkeypatch.setattr(topk_blocks, "QUERIES", bundle)
    r = np.random.default_rng(2)
    vecs = [[float(c) for c in v] for v in r.normal(size=(150, 4)).round(1)]
    rows = list(enumerate(vecs)) + [(3, vecs[0]), (5, vecs[5]), (None, [3.0] * 4)] + [(1000 + i, [0.5] * 4) for i in range(60)]    # repeats and many ties
    rows += [(2000, [1e9, -1e9, 0.0, 0.0]), (2001, [0.1, 0.2])]
    padded = [(i, v + [0.0] * (4 - len(v))) for i, v in rows]
    bad = [(0, None), (5, [NAN] * 4), (10, [INF, 0.0, 0.0, 0.0]), (15, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").repartition(3).select("*", F.lit("x").alias("score"), F.lit(1).alias("row"))
    got = topk_blocks.exact_top_k(df, F.col("vec_id") % 5 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == _top(padded, lambda q: q % 5 == 0, 5)
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, topk_blocks.exact_top_k(few, F.col("vec_id") == 0).collect())) == [(0, 1, 50, 256 * 512)]
    assert topk_blocks.exact_top_k(df.limit(0), F.lit(True)).count() == 0


def test_top_k_skips_blocks_that_cannot_win():
    """Rows far from the query lie in blocks whose bound is below the kth score."""
    m = np.zeros((5120, 2), np.int64)
    m[:512] = [100, 100]
    index = topk_blocks.ForwardIndex(m, 0)
    best, row = np.full((1, 5), topk_blocks._LEAST), np.full((1, 5), topk_blocks._LAST)
    assert index.search(np.array([[1, 1]]), np.array([0]), best, row) == 1
    assert row.tolist() == [[1, 2, 3, 4, 5]] and best.tolist() == [[200] * 5]
