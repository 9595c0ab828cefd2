"""Bigram language model in sharded Elias-Fano tries with quantised smoothed probabilities.

p(w | v) = max(c(v w) - D, 0) / T(v) + D N(v) / T(v) * p(w),   p(w) = (c(w) + 1) / (N + V + 1),
with T(v) the occurrences and N(v) the different successors of context v; D discounts (absolute discounting,
interpolated). A context that training never saw leaves p(w). The end of a text is a word of its own and the context of
a text's first word. Words are known by 64-bit hashes, successors within a context by the upper 48 bits.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, ship

DISCOUNT = 0.75
STEPS = 4096                    # quantisation steps a decade
CHUNK_BYTES = 10 << 20          # text that is counted and scored at a time
SHARD_BYTES = 6 << 20           # text that a shard of the model answers for
_END = xxhash.xxh3_64_intdigest(b"")
_BODIES = "chunk bigint, ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, vocabulary binary"
_ASKED = "chunk bigint, shard int, words binary, counts binary, fanout binary, successors binary, pairs binary"


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit steps of -log10 p, from 1 on; 0 is left for what doesn't occur."""
    return np.minimum(1 + np.round(-np.log10(p) * STEPS), 65535).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10.0 ** (-(q.astype(np.float64) - 1) / STEPS), 0.0)


class EliasFano:
    """A monotone sequence: low bits in whole bytes, high bits as unary gaps in a bit vector."""

    def __init__(self, values: np.ndarray, bits: int):
        n = max(1, len(values))
        self.low_bytes = max(0, -(-(bits - int(np.log2(n)) - 1) // 8)) if bits else 0
        shift = np.uint64(8 * self.low_bytes)
        v = values.astype(np.uint64)
        self.low = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :self.low_bytes].copy()
        high = (v >> shift).astype(np.int64) if self.low_bytes < 8 else np.zeros(len(v), np.int64)
        marks = np.zeros(int(high[-1]) + len(v) + 1 if len(v) else 1, np.uint8)
        marks[high + np.arange(len(v))] = 1
        self.size, self.high = len(v), np.packbits(marks)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[:self.size]
        full = np.zeros((self.size, 8), np.uint8)
        full[:, :self.low_bytes] = self.low
        low = full.view("<u8").ravel()
        return low if self.low_bytes == 8 else low | ((ones - np.arange(self.size)).astype(np.uint64) << np.uint64(8 * self.low_bytes))


class Trie:
    """Two levels: words with counts, back-off weights and pointers; successors, ascending within their context.

    The successors of word k stand from pointer k to pointer k + 1. A level's arrays are written to a file without a
    name and memory-mapped, so they are neither heap nor left behind; level 1 and the pointers are decoded once.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, context: np.ndarray, successor: np.ndarray, pair: np.ndarray):
        """``words`` ascending; (context, successor) ascending, context as a position in words; all pairs occur."""
        total = np.bincount(context, pair, len(words))
        fan = np.bincount(context, minlength=len(words))
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, quantise(np.where(total > 0, DISCOUNT * fan / total, 1)), 0).astype(np.uint16)
        seen = quantise(np.maximum(pair - DISCOUNT, 1e-9) / total[context]) if len(pair) else np.empty(0, np.uint16)
        self.words, self.pointers = EliasFano(words, 64), EliasFano(np.r_[0, np.cumsum(fan)], 0)
        self._file = tempfile.TemporaryFile()
        low = np.stack([(successor >> np.uint64(s)).astype(np.uint16) for s in (32, 16, 0)], 1)
        self.counts, self.back, self.low, self.seen = (self._map(a) for a in (counts.astype(np.int64), back, low, seen))
        self._keys, self._at = self.words.values(), self.pointers.values().astype(np.int64)

    def _map(self, a: np.ndarray) -> np.ndarray:
        if not a.size:
            return a
        at = self._file.seek(0, 2)
        at = self._file.seek(-(-at // 8) * 8)
        self._file.write(np.ascontiguousarray(a).tobytes())
        self._file.flush()
        return np.memmap(self._file, a.dtype, "r", at, a.shape)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.words.low, self.words.high, self.pointers.high, self.counts, self.back, self.low, self.seen))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Positions of words on level 1; -1 where one is unknown."""
        k = np.searchsorted(self._keys, words)
        ok = k < len(self._keys)
        ok[ok] = self._keys[k[ok]] == words[ok]
        return np.where(ok, k, -1)

    def successors(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Quantised probabilities of (context position, successor) pairs, 0 where one doesn't occur: a binary search
        for the successor between the context's pointers, all pairs at once."""
        lo = np.where(context >= 0, self._at[context], 0)
        end = np.where(context >= 0, self._at[context + 1], 0)
        hi = end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._value(mid) < successor[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        out = np.zeros(len(lo), np.uint16)
        there = np.flatnonzero(lo < end)
        hit = there[self._value(lo[there]) == successor[there]]
        out[hit] = self.seen[lo[hit]]
        return out

    def _value(self, at: np.ndarray) -> np.ndarray:
        a = self.low[at].astype(np.uint64)
        return (a[:, 0] << np.uint64(32)) | (a[:, 1] << np.uint64(16)) | a[:, 2]


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        return k


def _pairs(tokens: np.ndarray, n_words: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Different (context, word) pairs of a chunk as context * n_words + word, and each token's position in them."""
    context = np.r_[end, tokens[:-1]].astype(np.int64)
    return np.unique(context * n_words + tokens, return_inverse=True)


def _split(vocabulary: np.ndarray, codes: np.ndarray, n_shards: int):
    """Order of words and of pairs by the shard of the (context) word; ascending hashes within a shard."""
    shard = (vocabulary % np.uint64(n_shards)).astype(np.int64)
    context = codes // len(vocabulary)
    return shard, np.argsort(shard, kind="stable"), context, np.argsort(shard[context], kind="stable")


def _pack(tokens: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress where numbers are small."""
    return np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _bodies(batches):
    """Texts as chunks of numbers: positions in the chunk's vocabulary, which is ascending by hash."""
    names = [c.split()[0] for c in _BODIES.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def emit(number, ids, held, parts, local):
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in local), np.uint64, len(local))
        vocabulary, place = np.unique(hashes, return_inverse=True)
        row = ((TaskContext.get().partitionId() << 32) | number, ids, held, [len(p) for p in parts], _pack(place[np.concatenate(parts)]), vocabulary.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    number, size = 0, 0
    ids, held, parts, local = [], [], [], _Local()
    for b in batch_rows(batches, 4 << 20):
        for i, text, out in zip(*(c.to_pylist() for c in b.columns)):
            raw = (text or "").encode("utf-8", "surrogatepass").lower()         # bytes: A-Z only, and ASCII space
            words = raw.split()
            words.append(b"")
            ids.append(i), held.append(out), parts.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield emit(number, ids, held, parts, local)
                number, size = number + 1, 0
                ids, held, parts, local = [], [], [], _Local()
    if ids:
        yield emit(number, ids, held, parts, local)


def _count(n_shards: int):
    """For each shard a chunk's words and word pairs with their training counts."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]                # one chunk at a time
                vocabulary, tokens = np.frombuffer(r["vocabulary"], np.uint64), _unpack(r["tokens"])
                train = np.repeat(~np.array(r["held"], bool), r["lengths"])
                counts = np.bincount(tokens, train, len(vocabulary)).astype(np.uint32)
                # Different pairs as in ``_pairs``, with their training counts: one array, sorted in place.
                key = np.r_[np.searchsorted(vocabulary, np.uint64(_END)), tokens[:-1]].astype(np.int64)
                key *= len(vocabulary)
                key += tokens
                key *= 2
                key += train
                del tokens
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] >> 1 != key[:-1] >> 1])
                codes, pair = key[first] >> 1, np.add.reduceat(key & 1, first).astype(np.uint32)
                del key
                shard, by_word, context, by_pair = _split(vocabulary, codes, n_shards)
                fan = np.bincount(context, minlength=len(vocabulary)).astype(np.uint32)
                follows = vocabulary[codes % len(vocabulary)] >> np.uint64(16)
                w_at = np.searchsorted(shard[by_word], np.arange(n_shards + 1))
                p_at = np.searchsorted(shard[context][by_pair], np.arange(n_shards + 1))
                for s in range(n_shards):
                    w, p = by_word[w_at[s]:w_at[s + 1]], by_pair[p_at[s]:p_at[s + 1]]
                    if len(w):
                        low = np.stack([(follows[p] >> np.uint64(k)).astype(np.uint16) for k in (32, 16, 0)])
                        row = (r["chunk"], s, vocabulary[w].tobytes(), counts[w].tobytes(), fan[w].tobytes(), low.tobytes(), pair[p].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    return run


def _read_successors(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint16).reshape(3, -1).astype(np.uint64)
    return (a[0] << np.uint64(32)) | (a[1] << np.uint64(16)) | a[2]


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: merges the chunks' counts into a trie, then looks every chunk's words and pairs up in it."""
    rows = []
    for r in pdf.itertuples():
        rows.append((r.chunk, np.frombuffer(r.words, np.uint64), np.frombuffer(r.counts, np.uint32), np.frombuffer(r.fanout, np.uint32),
                     _read_successors(r.successors), np.frombuffer(r.pairs, np.uint32)))
    words, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([r[2] for r in rows]), len(words)).astype(np.int64)
    context = np.repeat(place, np.concatenate([r[3] for r in rows]))
    successor, pair = np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows])
    context, successor, pair = context[pair > 0], successor[pair > 0], pair[pair > 0]
    order = np.lexsort((successor, context))
    context, successor, pair = context[order], successor[order], pair[order]
    first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])]) if len(pair) else np.empty(0, int)
    pair = np.add.reduceat(pair.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    context, successor = context[first], successor[first]
    known = (counts > 0) | (np.bincount(context, minlength=len(words)) > 0)
    trie = Trie(words[known], counts[known], (np.cumsum(known) - 1)[context], successor, pair)
    out = {"chunk": [], "shard": [], "counts": [], "back": [], "seen": [], "words": [], "tokens": [], "model_bytes": []}
    for chunk, w, _, fan, follows, _ in rows:
        at = trie.find(w)
        out["chunk"].append(chunk), out["shard"].append(pdf["shard"].iloc[0])
        known_at = np.maximum(at, 0)
        out["counts"].append(np.where(at >= 0, trie.counts[known_at] if len(trie.counts) else 0, 0).astype(np.int64).tobytes())
        out["back"].append(np.where(at >= 0, trie.back[known_at] if len(trie.back) else 0, 0).astype(np.uint16).tobytes())
        out["seen"].append(trie.successors(np.repeat(at, fan), follows).tobytes())
        head = len(out["chunk"]) == 1
        out["words"].append(int((counts > 0).sum()) if head else 0), out["tokens"].append(int(counts.sum()) if head else 0)
        out["model_bytes"].append(trie.nbytes() if head else 0)
    return pd.DataFrame(out)


def _scorer(n_shards: int, n_tokens: int, n_words: int):
    def score(bodies: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answers = answers.sort_values("shard")
        body = bodies.iloc[0]
        vocabulary, tokens = np.frombuffer(body["vocabulary"], np.uint64), _unpack(body["tokens"])
        codes, inverse = _pairs(tokens, len(vocabulary), int(np.searchsorted(vocabulary, np.uint64(_END))))
        _, by_word, context, by_pair = _split(vocabulary, codes, n_shards)
        counts, back, seen = np.empty(len(vocabulary), np.int64), np.empty(len(vocabulary), np.uint16), np.empty(len(codes), np.uint16)
        counts[by_word] = np.frombuffer(b"".join(answers["counts"]), np.int64)
        back[by_word] = np.frombuffer(b"".join(answers["back"]), np.uint16)
        seen[by_pair] = np.frombuffer(b"".join(answers["seen"]), np.uint16)
        plain = (counts + 1.0) / (n_tokens + n_words + 1.0)
        rest = np.where(back > 0, dequantise(back), 1.0)
        p = np.log10(dequantise(seen) + rest[context] * plain[codes % len(vocabulary)])
        lengths = np.asarray(body["lengths"], np.int64)
        first = np.cumsum(lengths) - lengths
        return pd.DataFrame({
            "doc_id": pd.array([None if i is None or i != i else int(i) for i in body["ids"]], "Int64"), "held_out": np.asarray(body["held"], bool), "n_tokens": lengths,
            "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), first), "train_tokens": n_tokens,
            "base_score": np.add.reduceat(np.log10(plain)[tokens], first), "score": np.add.reduceat(p[inverse], first)})

    return score


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of its probability).

    The model learns from all rows where ``held_out`` is false and scores every row, on whole texts.

    1. Tasks turn texts into chunks of about ``CHUNK_BYTES``, written as numbers, and count each chunk's words and
       word pairs before these are shuffled; a very frequent pair is one entry a chunk.
    2. Words, and pairs by their context, go to shards, as many as the text's size asks for. A shard merges the
       chunks' counts into its trie and answers each chunk's words and pairs, in the chunk's order.
    3. A chunk and its answers meet again and its texts are scored. No task holds the vocabulary or the model.

    Null and empty texts are an end alone. Null and repeated ids, and repeated rows, are texts of their own. Without
    training rows every word has probability 1, as the base has. An empty table gives no rows. Only the two columns
    and those of ``held_out`` are read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ngram_lm")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), held_out.alias("held"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(4, -(-n_bytes // SHARD_BYTES))
    bodies = scratch.write(rows.mapInArrow(_bodies, _BODIES), "chunks")
    asked = bodies.mapInArrow(_count(n_shards), _ASKED)
    answers = scratch.write(asked.groupBy("shard").applyInPandas(
        _answer, "chunk bigint, shard int, counts binary, back binary, seen binary, words bigint, tokens bigint, model_bytes bigint"), "answers")
    n_tokens, n_words = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("words")).first())
    return bodies.groupBy("chunk").cogroup(answers.select("chunk", "shard", "counts", "back", "seen").groupBy("chunk")).applyInPandas(
        _scorer(n_shards, n_tokens, n_words),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
