"""Best-fit packing of tokenised documents into sequences of fixed length.

Supersteps work on *runs*: pieces are range-sorted by length and ranked by Spark, and a run is all pieces, or all open
gaps, of one size. Sizes are at most ``max_len``, so the runs that a superstep sweeps and the placements it makes are
bounded by ``max_len`` whatever the number of documents.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, cache_of, only_cache_of, ship

TOKENIZER = "byte_bpe_50k.json"
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_CACHE_ENTRIES = 350_000
#: Texts of these characters only are split here, by the vocabulary's pattern written out for them; any other text
#: goes to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ‐-‧]*")
_SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zªµºÀ-ÖØ-öø-ſ]+| ?[0-9²³¹¼-¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ſ0-9²³¹¼-¾]+|\s+(?!\S)|\s+")
#: The vocabulary's sign for each byte: printable ones for themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
_BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(sorted({*range(0x100)} - {*_PRINTABLE}))}
_workers: dict[str, "TokenIds"] = {}
cache_of("packing", _workers.clear)


class TokenIds(dict):
    """Token ids of whole texts as little-endian 32-bit bytes; a dict of the split parts seen lately (two bounded
    generations: a full one becomes the old one, from which parts still in use come back)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True     # their strings in a text are ordinary text
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part) or self.encode_part(part)
        if len(part) <= 64:
            if len(self) >= _CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_part(self, part: str) -> bytes:
        """One split part, straight to the vocabulary's merges."""
        if part.isascii() and part.isprintable():
            signs = part.replace(" ", "Ġ")
        else:
            signs = part.encode().decode("latin-1").translate(_BYTE_SIGNS)
        ids = [t.id for t in self.tokenizer.model.tokenize(signs)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


def token_ids(path: str | None = None) -> TokenIds:
    """The worker's tokenizer; ``path`` defaults to the public byte-level vocabulary of 50k entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _workers:
        _workers[path] = TokenIds(path)
    return _workers[path]


def cut(n_ids: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after the rest."""
    first = (n_ids - 1) % max_len + 1
    return [(0, first)] + [(s, max_len) for s in range(first, n_ids, max_len)]


def plan_runs(counts: dict[int, int], max_len: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Best-fit decreasing over runs: length -> (first rank, first sequence, offset) of consecutive placements.

    For each length, longest first, the sweep goes to the smallest gap that holds it (its successor); where more
    gaps than pieces (or more pieces than gaps) compete, pieces take gaps in rank order, the gaps shrink and the
    sweep goes on from the smaller ones, which are then the best fit. New sequences open where no gap fits.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)      # gap -> runs (first sequence, number)
    out, opened = {}, 0
    for length in sorted(counts, reverse=True):
        rank, left, placed = 0, counts[length], []
        while left:
            gap = next((g for g in range(length, max_len + 1) if gaps.get(g)), None)
            if gap is None:
                gap = max_len
                need = -(-left // (max_len // length))
                gaps[gap].append((opened, need))
                opened += need
            first, n = gaps[gap].pop()
            each = min(gap // length, left)                  # pieces of this length that one such gap takes
            used = min(n, left // each)
            if used < n:
                gaps[gap].append((first + used, n - used))
            for j in range(each):
                placed.append((rank, first, max_len - gap + j * length))
                rank += used
            left -= used * each
            if rest := gap - each * length:
                gaps[rest].append((first, used))
        out[length] = tuple(np.array(x, np.int64) for x in zip(*placed))
    return out


def token_pieces(docs: DataFrame, max_len: int, end_id: int, tokenizer: str | None) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32."""
    def tokenise(batches):
        only_cache_of("packing")
        ids_of = token_ids(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        for b in batch_rows(batches, 4 << 20):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = ids_of(text or "") + end
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, max_len))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(tokenise, _PIECES)


def _rank_in_part(batches):
    """Rank of each row among the rows of its length in this range partition (rows come sorted by length)."""
    part, last, rank = TaskContext.get().partitionId(), None, 0
    for b in batches:
        length = b.column(b.schema.get_field_index("length")).to_numpy()
        first = np.flatnonzero(np.r_[True, length[1:] != length[:-1]]) if len(length) else np.array([], int)
        runs = np.diff(np.r_[first, len(length)])
        ranks = np.arange(len(length)) - np.repeat(first, runs)
        if len(length):
            if length[0] == last:
                ranks[:runs[0]] += rank
            last, rank = length[-1], ranks[-1] + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(ranks.astype(np.int64))],
                                         names=[*b.schema.names, "part", "rank"])


def pack_best_fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_len: int = 1024, end_id: int = 2,
                  tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; only those longer than ``max_len`` are cut, the remainder first.
    Pieces are range-sorted by length (equal lengths split by id, so copies don't meet in one task); every partition
    reports how many pieces of each length it has, at most ``max_len`` plus one report a partition in all. From
    these follow global ranks within a length and the placements of ``plan_runs``, which each row looks up by rank.

    Null and empty texts are documents of ``end_id`` alone. Null ids and repeated rows are kept as separate
    documents. An empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "pack_best_fit")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = scratch.write(token_pieces(rows, max_len, end_id, tokenizer), "pieces")
    keys = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.monotonically_increasing_id()]
    ranged = pieces.withColumn("tie", keys.pop()).repartitionByRange(*keys, F.col("tie")).sortWithinPartitions(*keys, F.col("tie")).drop("tie")
    ranked = scratch.write(ranged.mapInArrow(_rank_in_part, f"{_PIECES}, part int, rank bigint"), "ranked")
    scratch.drop("pieces")

    counts: dict[int, int] = defaultdict(int)
    base: dict[tuple[int, int], int] = {}
    for r in sorted(ranked.groupBy("part", "length").count().collect(), key=lambda r: r["part"]):
        base[r["part"], r["length"]] = counts[r["length"]]
        counts[r["length"]] += r["count"]
    plan = spark.sparkContext.broadcast((base, plan_runs(counts, max_len)))

    def place(batches):
        base, runs = plan.value
        for b in batches:
            length = b.column(3).to_numpy()
            part, rank = b.column(5).to_numpy(), b.column(6).to_numpy()
            seq, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for p, n in np.unique(np.stack([part, length], 1), axis=0).tolist():
                own = (part == p) & (length == n)
                r = rank[own] + base[p, n]
                first, sequence, at = runs[n]
                k = np.searchsorted(first, r, "right") - 1
                seq[own], offset[own] = sequence[k] + r - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(offset)],
                                             names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{_PIECES}, sequence_id bigint, offset bigint")


def packed_sequences(docs: DataFrame, placed: DataFrame, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
                     tokenizer: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed token sequences; a group here is one sequence, at most ``max_len`` ids.

    ``doc_id`` must be unique. Texts are shuffled once, by document.
    """
    ship(docs.sparkSession)
    spots = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("spots"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(spots, "doc_id")

    def fill(batches):
        ids_of = token_ids(tokenizer).ids
        end = np.array([end_id], "<u4").tobytes()
        for b in batch_rows(batches, 4 << 20):
            seq, off, ids = [], [], []
            for row in b.to_pylist():
                whole = np.frombuffer(ids_of(row["text"] or "") + end, "<u4")
                for s in row["spots"]:
                    seq.append(s["sequence_id"]), off.append(s["offset"])
                    ids.append(whole[s["start"]:s["start"] + s["length"]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["sequence_id", "offset", "ids"])

    parts = rows.mapInArrow(fill, "sequence_id bigint, offset bigint, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
