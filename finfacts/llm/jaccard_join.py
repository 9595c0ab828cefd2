"""Similarity join on word shingles with Bayesian pruning of candidate pairs (Satuluri and Parthasarathy, 2012)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm import words as W
from finfacts.llm.common import Scratch, batch_rows, connected_components, ship, spanning

BANDS, ROWS = 28, 5             # a pair at 0.8 shares no band with probability 1.5e-5, at 0.85 with 8e-8
STEP = 20                       # MinHash values compared between two looks at the posterior
BLOCK = 512                     # texts of a candidate cluster that meet in one task, on either side
_SEEDS = W.minhash_seeds(BANDS * ROWS)


def least_matches(threshold: float, tolerance: float, n_hashes: int = BANDS * ROWS, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, fewest matches at which a pair stays).

    With a uniform prior on the similarity s, P(s >= threshold | m of n values match) is
    P(Binomial(n + 1, threshold) <= m); a pair is dropped as soon as this falls below ``tolerance``.
    """
    out = []
    for n in range(step, n_hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, open_: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of MinHash rows that are ``open_`` and never pruned; values are compared step by step."""
    done, (n, m) = 0, least[0]
    same = np.zeros(open_.shape, np.int16)
    for k in range(n):
        same += a[:, None, k] == b[None, :, k]
    i, j = np.nonzero(open_ & (same >= m))
    got, done = same[i, j], n
    for n, m in least[1:]:
        for s in range(0, len(i), 100_000):
            part = slice(s, s + 100_000)
            got[part] += (a[i[part], done:n] == b[j[part], done:n]).sum(1, dtype=np.int16)
        keep = got >= m
        i, j, got, done = i[keep], j[keep], got[keep], n
    return i, j


def overlaps(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact intersection sizes of the shingle sets of pairs (i, j)."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    rows, cols = np.unique(i), np.unique(j)
    left, right = np.concatenate([a[x] for x in rows]), np.concatenate([b[y] for y in cols])
    lrow, rrow = np.repeat(np.arange(len(rows)), [len(a[x]) for x in rows]), np.repeat(np.arange(len(cols)), [len(b[y]) for y in cols])
    common = np.intersect1d(left, right)                # a shingle on one side only adds to no intersection
    total = np.zeros((len(rows), len(cols)), np.float32)
    lpos, rpos = np.searchsorted(common, left), np.searchsorted(common, right)
    lok = (lpos < len(common)) & (common[np.minimum(lpos, len(common) - 1)] == left) if len(common) else np.zeros(len(left), bool)
    rok = (rpos < len(common)) & (common[np.minimum(rpos, len(common) - 1)] == right) if len(common) else np.zeros(len(right), bool)
    for c in range(0, len(common), 4096):
        x, y = np.zeros((len(rows), 4096), np.float32), np.zeros((len(cols), 4096), np.float32)
        s = lok & (lpos >= c) & (lpos < c + 4096)
        x[lrow[s], lpos[s] - c] = 1
        s = rok & (rpos >= c) & (rpos < c + 4096)
        y[rrow[s], rpos[s] - c] = 1
        total += x @ y.T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def _signatures(batches):
    """doc_id, text_key -> node (hash of the word sequence), MinHash values; both are null for texts without words."""
    for b in batch_rows(batches, 2 << 20):
        hashes = [W.word_hashes(t) for t in b.column(2).to_pylist()]
        have = [k for k, h in enumerate(hashes) if len(h)]
        node, sig = [None] * len(hashes), [None] * len(hashes)
        for k, s in zip(have, W.minhash(*W.shingles([hashes[k] for k in have]), _SEEDS) if have else ()):
            node[k], sig[k] = int(np.uint64(xxhash.xxh3_64_intdigest(hashes[k].tobytes())).astype(np.int64)), s.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(sig, pa.binary())],
                                         names=["doc_id", "text_key", "node", "sig"])


def _bands(batches):
    for b in batch_rows(batches):
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
        for r in range(ROWS):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(key.ravel().astype(np.int64))], names=["node", "key"])


def _members(batches):
    """Adds a text's sorted shingle set and MinHash values."""
    for b in batch_rows(batches, 2 << 20):
        hashes = [W.word_hashes(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
        values, first = W.shingles(hashes)
        sig = W.minhash(values, first, _SEEDS)
        sets = [np.unique(x).tobytes() for x in np.split(values, first[1:])]
        keep = [k for k, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(sets, pa.binary())],
                                         names=[*(b.schema.names[k] for k in keep), "sig", "set"])


def _verifier(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, links, ends = [], [], []
        for (_, left, right), g in pdf.groupby(["cluster", "left", "right"], sort=False):
            if len(g) < 2:
                continue
            own = g["block"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(len(g), -1)
            sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
            size = np.array([len(s) for s in sets])
            x = np.flatnonzero(own == left)
            y = np.flatnonzero(own == right)
            ok = np.minimum(size[x][:, None], size[y]) >= threshold * np.maximum(size[x][:, None], size[y])
            if left == right:
                ok &= x[:, None] < y
            i, j = surviving(sig[x], sig[y], ok, least)
            if not len(i):
                continue
            i, j = x[i], y[j]
            both = overlaps(sets, sets, i, j)
            # both / union >= threshold, as numbers that a double holds exactly
            hit = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[hit], j[hit]
            copies, node = g["copies"].to_numpy(), g["node"].to_numpy()
            n = np.bincount(i, copies[j], len(g)) + np.bincount(j, copies[i], len(g))
            star = dict(spanning(len(g), i, j))
            for k in np.flatnonzero(n):
                nodes.append(node[k]), links.append(int(n[k])), ends.append(node[star.get(k, k)])
        return pd.DataFrame({"node": nodes, "links": links, "end": ends}).astype("int64")

    return verify


def _texts_of(rows: DataFrame, member: DataFrame) -> DataFrame:
    """(text_key, text) of a little more than the rows whose key is in ``member``.

    A Bloom filter of 2^20 words of 64 bits, whatever the number of keys, is broadcast, so that texts which can't be
    members don't go into the shuffle of the join; where it fills up, more texts pass and the join sorts them out.
    """
    word = F.pmod("text_key", F.lit(1 << 20)).alias("word")
    mask = F.expr("shiftleft(1L, cast(shiftrightunsigned(text_key, 20) & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(text_key, 26) & 63 as int))")
    bits = member.groupBy(word).agg(F.bit_or(mask).alias("bits"))
    keyed = rows.select("text_key", "text", word, mask.alias("mask"))
    return keyed.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("text_key", "text")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """One row a document: doc_id, text_key, class_id, n_links, kept.

    Documents link if the Jaccard similarity of their sets of five-word shingles (lower case, split at white space)
    is ``threshold`` (0.8 or more) or above. ``n_links`` counts the other documents that a document links with, copies included;
    ``class_id`` is the smallest doc_id connected by links; ``kept`` marks one document of each class.

    1. Documents of one word sequence are one text (64-bit hash); copies are counted, never paired.
    2. Texts that share a band of MinHash values are joined by star edges to the smallest text of the band, and the
       components of these are the candidate clusters: rows grow with the texts, not with pairs.
    3. A cluster is cut into blocks of ``BLOCK`` texts and every pair of blocks is a unit of its own. Within it,
       pairs whose sizes can't reach the threshold are left out, MinHash values are compared ``STEP`` at a time,
       a pair goes when the posterior probability of reaching the threshold falls below ``tolerance``, and the
       rest are verified on the whole shingle sets. Tasks return link counts and spanning edges, not pairs.
    4. Components of the spanning edges are the classes.

    Texts without words (null, empty, blank) link with nothing and are a class each. Rows that repeat an id are
    documents of their own; a null id stays null and its class takes the smallest id that isn't null. An empty table
    gives no rows; other columns aren't read. ``text_key`` is the 64-bit hash of the text, for joining back.
    """
    if threshold < 0.8:
        raise ValueError("bands are made for similarities of 0.8 or more; lower ones would be missed")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near_duplicates")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"),
                       F.col(f"`{text}`").alias("text"))
    every = scratch.write(rows.mapInArrow(_signatures, "doc_id bigint, text_key bigint, node bigint, sig binary"), "signed")
    signed = every.where("node is not null")
    bands = scratch.write(signed.select("node", "sig").dropDuplicates(["node"]).mapInArrow(_bands, "node bigint, key bigint"), "bands")
    # Both sides of this join are written tables, so AQE can split a band key that many texts share.
    low = scratch.write(bands.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").select("key", "low"), "low")
    stars = scratch.write(bands.join(low, "key").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "stars")
    scratch.drop("bands", "low")
    clusters = connected_components(stars, scratch, "candidates").select("node", F.col("component").alias("cluster"))

    texts = signed.groupBy("node").agg(F.min("text_key").alias("text_key"), F.count("*").alias("copies"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    member = clusters.join(size, "cluster").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).join(texts, "node")
    member = scratch.write(member.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("n"), "member")
    # A hot text is one row here: its copies meet in a partial aggregation before they are shuffled.
    sets = _texts_of(rows, member).join(member, "text_key").dropDuplicates(["node"]).select(
        "cluster", "node", "copies", "blocks", "block", "text")
    member_schema = "cluster bigint, node bigint, copies bigint, blocks int, block int, sig binary, set binary"
    sets = scratch.write(sets.mapInArrow(_members, member_schema), "sets")
    scratch.drop("stars", "member")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = sets.withColumn("other", other).select("cluster", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
                                                   "block", "node", "copies", "sig", "set")
    total = sets.agg(F.sum("blocks")).first()[0] or 0
    bins = max(1, -(-total // BLOCK))
    pairs = pairs.withColumn("bin", F.pmod(F.xxhash64("cluster", "left", "right"), F.lit(bins)))
    found = scratch.write(pairs.groupBy("bin").applyInPandas(_verifier(threshold, tolerance), "node bigint, links bigint, end bigint"), "found")

    classes = connected_components(found.select(F.col("node").alias("a"), F.col("end").alias("b")), scratch, "classes")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    copies = signed.groupBy("node").agg(F.count("*").alias("copies"))
    known = copies.join(links, "node", "left").join(classes, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    per_doc = scratch.write(signed.select("doc_id", "text_key", "node", F.monotonically_increasing_id().alias("tie")).join(known, "node"), "per_doc")
    blank = scratch.write(every.where("node is null").select("doc_id", "text_key", F.col("doc_id").alias("class_id"),
                                                             F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")), "blank")
    scratch.drop("signed", "sets", "found")
    # Nulls sort last here: the smallest id that isn't null stands for the class.
    first = scratch.write(per_doc.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("first")).select(
        "class", F.col("first.doc_id").alias("class_id"), F.col("first.tie").alias("first")), "first")
    out = per_doc.join(first, "class").select("doc_id", "text_key", "class_id", "n_links", (F.col("tie") == F.col("first")).alias("kept"))
    return out.unionByName(blank)
