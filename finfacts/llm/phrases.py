"""Phrase collocations from a weighted de Bruijn graph of the words of each language.

Nodes are three-word sequences, edges the four-word sequences that join two overlapping nodes, weighted by how often
they occur. Counts of shorter phrases aren't counted again: what flows out of a node, plus the sequences that end
there, is the node's own count, and so on down to single words.

1. ``frequent_filter``: every sequence of one to three words is known by a hash; tasks count them per chunk of text,
   shards of the hash space add the chunks up, and what may reach ``min_count`` sets a bit of one filter of fixed size.
   Hashes that fall together only let more through, so the filter never hides a frequent phrase.
2. ``gram_flows``: each word position yields one record: the longest sequence from there, of four words at most, inside
   its piece, whose nodes pass the filter. Records are words, not hashes, so their sums are exact.
3. ``phrase_counts``: each record counts for all its beginnings: flow out of a node, plus ends in it.
4. ``compact_paths``: edges of equal weight that meet in a node without branches become one path, kept in segments.
5. ``collocations``: scores by the weakest cut, phrases covered by longer ones left out, the best of each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, ship
from finfacts.llm.words import mix

LONGEST = 4
CHUNK_WORDS = 1 << 19            # words that one task counts at a time
FILTER_BITS = 27                 # the filter has 2**27 bits (16 MB) whatever the input
SHARD_BYTES = 8 << 20            # bytes of text per shard of the hash space
SEGMENT = 256                    # edges of a path kept in one row
_SEGMENT_BITS = 19               # the filter is put together in parts of 2**19 bits

_TO_BREAK = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Numbers of one language's words within a chunk."""

    def __init__(self, lang: str, known: list, hashes: list):
        self.prefix, self.known, self.hashes = lang.encode("utf-8", "surrogatepass") + b"\x00", known, hashes

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.known)
        self.known.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(self.prefix + word))
        return n


class Chunk:
    """Word numbers of many pieces in a row; ``left`` counts the words from a position to its piece's end."""

    def __init__(self):
        self.known, self.hashes, self.by_lang, self.lang_words = [], [], {}, {}
        self.parts, self.lengths, self.size = [], [], 0

    def add(self, lang: str, text: bytes) -> None:
        words = self.by_lang.get(lang)
        if words is None:
            words = self.by_lang[lang] = _Words(lang, self.known, self.hashes)
        before = self.size
        for piece in text.lower().translate(_TO_BREAK).split(b"\n"):
            w = piece.split()
            if w:
                self.parts.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
                self.lengths.append(len(w))
                self.size += len(w)
        self.lang_words[lang] = self.lang_words.get(lang, 0) + self.size - before

    def close(self) -> None:
        self.ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        n = np.array(self.lengths, np.int32)
        self.left = np.repeat(np.cumsum(n, dtype=np.int32), n) - np.arange(self.size, dtype=np.int32)
        self.parts = self.lengths = None

    def gram_hashes(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number of words and hashes of the sequences of 1, 2 and 3 words from each position (any value past a piece's end)."""
        one = np.array(self.hashes, np.uint64)[self.ids]
        h = one
        yield 1, h
        for k in (1, 2):
            nxt = np.zeros_like(one)
            nxt[:max(self.size - k, 0)] = one[k:]
            h = mix(h * _STEP + nxt)
            yield k + 1, h


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of (lang, text) rows; a text is never split over chunks."""
    chunk = Chunk()
    for b in batch_rows(batches):
        langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
        for i, lang in enumerate(langs):
            chunk.add(lang, texts[i].as_py())
            if chunk.size >= CHUNK_WORDS:
                chunk.close()
                yield chunk
                chunk = Chunk()
    if chunk.size:
        chunk.close()
        yield chunk


def _planes(values: np.ndarray) -> bytes:
    """32-bit values as byte planes: small ones, such as the steps between sorted values, compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _key(h: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard (upper 32 bits) and value within the shard of a hash."""
    return ((h >> np.uint64(32)) % np.uint64(n_shards)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _count_shards(n_shards: int, most: int):
    def run(batches):
        for chunk in _chunks(batches):
            key = np.concatenate([_key(h[chunk.left >= k], n_shards) for k, h in chunk.gram_hashes()])
            key.sort()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.minimum(np.diff(first, append=len(key)), most).astype(np.uint32)
            key = key[first]
            shard, low = (key >> np.uint64(32)).astype(np.int32), key.astype(np.uint32)
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            parts = list(zip(cut, [*cut[1:], len(key)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[cut], pa.int32()), pa.array([_planes(np.diff(low[i:j], prepend=np.uint32(0))) for i, j in parts], pa.binary()),
                pa.array([_planes(count[i:j]) for i, j in parts], pa.binary())], names=["shard", "grams", "counts"])
    return run


def _bit(key: np.ndarray, bits: int) -> np.ndarray:
    """Bit of the filter for a key."""
    return (mix(key) >> np.uint64(64 - bits)).astype(np.uint32)


def _frequent(min_count: int, bits: int):
    """Bits of one shard's sequences that occur often enough, by part of the filter."""
    part_bits = min(_SEGMENT_BITS, bits)

    def run(key, table):
        both = np.concatenate([np.cumsum(_from_planes(g.as_py()), dtype=np.uint64) << np.uint64(32) | _from_planes(c.as_py())
                               for g, c in zip(table.column("grams"), table.column("counts"))])
        both.sort()
        low = (both >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        often = low[first[np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) >= min_count]]
        bit = np.unique(_bit(np.uint64(key[0].as_py() << 32) | often.astype(np.uint64), bits))
        part = bit >> np.uint32(part_bits)
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(bit) else np.empty(0, np.int64)
        return pa.table({"part": pa.array(part[cut].astype(np.int32), pa.int32()),
                         "bits": pa.array([x.tobytes() for x in np.split(bit, cut[1:])] if len(cut) else [], pa.binary())})
    return run


def _part(bits: int):
    """One part of the filter as packed bits."""
    part_bits = min(_SEGMENT_BITS, bits)

    def run(key, table):
        on = np.zeros(1 << part_bits, bool)
        for x in table.column("bits"):
            on[np.frombuffer(x.as_py(), np.uint32) & np.uint32((1 << part_bits) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([np.packbits(on).tobytes()], pa.binary())})
    return run


def frequent_filter(texts: DataFrame, min_count: int, n_shards: int, bits: int = FILTER_BITS) -> bytes:
    """Packed bits, ``2**bits`` of them whatever the input: set for every sequence of one to three words that occurs
    ``min_count`` times or more, and for some that don't."""
    counted = texts.mapInArrow(_count_shards(n_shards, min_count), "shard int, grams binary, counts binary")
    often = counted.groupBy("shard").applyInArrow(_frequent(min_count, bits), "part int, bits binary")
    parts = often.groupBy("part").applyInArrow(_part(bits), "part int, packed binary")
    size = (1 << min(_SEGMENT_BITS, bits)) // 8
    out = bytearray((1 << bits) // 8)
    for row in parts.toLocalIterator():      # 2**bits bits in all
        out[row["part"] * size:(row["part"] + 1) * size] = row["packed"]
    return bytes(out)


def _flows(chunk: Chunk, n_shards: int, packed: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first position, count) of the longest sequences whose nodes pass the filter, without repetition."""
    def passes(h):
        b = _bit(_key(h, n_shards), bits)
        return (packed[b >> np.uint32(3)] >> (np.uint32(7) - (b & np.uint32(7))).astype(np.uint8)) & np.uint8(1) == 1

    ok, depth = None, np.zeros(chunk.size, np.int8)
    for k, h in chunk.gram_hashes():
        if ok is None:
            ok = passes(h)
        else:
            ok = (chunk.left >= k) & ok & np.append(ok[1:], False)
            at = np.flatnonzero(ok)
            ok[at[~passes(h[at])]] = False
        depth[ok] = k
    depth[(chunk.left >= LONGEST) & ok & np.append(ok[1:], False)] = LONGEST    # an edge between two nodes that pass
    # Exact identity by numbering sequences word by word: (number of the beginning, next word).
    at = np.flatnonzero(depth)
    name = chunk.ids[at].astype(np.int64)
    for k in range(1, LONGEST + 1):
        here = depth[at] == k
        if here.any():
            _, first, count = np.unique(name[here], return_index=True, return_counts=True)
            yield k, at[here][first], count
        at, name = at[~here], name[~here]
        if k < LONGEST and len(at):
            _, name = np.unique(name << 32 | chunk.ids[at + k], return_inverse=True)
            name = name.astype(np.int64)


def _emit_flows(n_shards: int, broadcast, bits: int):
    def run(batches):
        packed = np.frombuffer(broadcast.value, np.uint8)
        for chunk in _chunks(batches):
            words = np.array(chunk.known, object)
            langs = np.empty(len(words), object)
            for lang, d in chunk.by_lang.items():
                langs[np.fromiter(d.values(), np.int64, len(d))] = lang
            yield _records(list(chunk.lang_words), 0, [b""] * len(chunk.lang_words), list(chunk.lang_words.values()))
            for k, at, count in _flows(chunk, n_shards, packed, bits):
                for s in range(0, len(at), 1 << 16):
                    p = at[s:s + (1 << 16)]
                    gram = words[chunk.ids[p]]
                    for j in range(1, k):
                        gram = gram + b" " + words[chunk.ids[p + j]]
                    yield _records(list(langs[chunk.ids[p]]), k, list(gram), count[s:s + (1 << 16)])
    return run


def _records(langs, k, grams, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([k] * len(grams), pa.int32()),
                                       pa.array(grams, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                                      names=["lang", "k", "phrase", "c"])


def gram_flows(docs: DataFrame, text: str, lang: str, min_count: int, scratch: Scratch, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, k, phrase, c): how often each word sequence is the longest one from a position; k = 0: all words of a lang."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // SHARD_BYTES))
    packed = spark.sparkContext.broadcast(frequent_filter(texts, min_count, n_shards, bits))
    out = texts.mapInArrow(_emit_flows(n_shards, packed, bits), "lang string, k int, phrase string, c long")
    return scratch.write(out.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("c")), "flows")


def _words(phrase: str, first: int, count: int):
    """``count`` words of a phrase from word ``first`` (0-based) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, count), " ")


def _cut(phrase: str, n):
    """The first ``n`` words, or the last ``-n``."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n)


def phrase_counts(flows: DataFrame, min_count: int, scratch: Scratch) -> DataFrame:
    """(lang, k, phrase, f) of all sequences of 1 to 4 words that occur ``min_count`` times or more.

    A sequence's count is the flow out of its node (records that go on) plus the records that end in it.
    """
    steps = flows.where("k > 0").select("lang", "c", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("k")), lambda j: _cut("phrase", j))).alias("k", "phrase"))
    counts = steps.groupBy("lang", "k", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= min_count)
    return scratch.write(counts.select("lang", (F.col("k") + 1).alias("k"), "phrase", "f"), "counts")


def compact_paths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, words, f): the edges (lang, phrase of four words, f) as paths of overlapping words, all of one weight.

    Two edges are joined where the node between them has no other edge and both weigh the same. Every edge looks for
    its path's head by pointer doubling; a ring has no head, and its edges stay alone. A path is kept in segments of
    at most ``SEGMENT`` edges, so no task holds a whole path.
    """
    e = edges.select("lang", "phrase", "f", _words("phrase", 0, 3).alias("src"), _words("phrase", 1, 3).alias("dst"))
    into = e.groupBy("lang", F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("phrase").alias("prev"), F.min("f").alias("f_in"))
    out = e.groupBy("lang", F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("phrase").alias("phrase"), F.min("f").alias("f"))
    links = into.join(out, ["lang", "node"]).where("n_in = 1 and n_out = 1 and f_in = f and prev <> phrase").select("lang", "phrase", "prev")
    # head: the edge reached so far going back ``dist`` steps; done: it is a path's head.
    cur = scratch.write(e.select("lang", "phrase", "f").join(links, ["lang", "phrase"], "left")
                        .select("lang", "phrase", "f", F.coalesce("prev", "phrase").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("dist"),
                                F.col("prev").isNull().alias("done")), "paths_0")
    left, i = None, 0
    while True:
        now = cur.where("not done").count()
        if now == 0 or now == left:
            break
        left, i = now, i + 1
        back = cur.select("lang", F.col("phrase").alias("head"), F.col("head").alias("head2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        nxt = cur.where("not done").join(back, ["lang", "head"]).select(
            "lang", "phrase", "f", F.col("head2").alias("head"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        cur = scratch.write(cur.where("done").unionByName(nxt), f"paths_{i}")
        scratch.drop(f"paths_{i - 1}")
    alone = ~F.col("done")
    p = cur.select("lang", "phrase", "f", F.when(alone, F.col("phrase")).otherwise(F.col("head")).alias("head"), F.when(alone, 0).otherwise(F.col("dist")).alias("dist"))
    seg = p.groupBy("lang", "head", "f", F.floor(F.col("dist") / SEGMENT).alias("segment")).agg(
        F.min_by("phrase", "dist").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("dist", F.substring_index("phrase", " ", -1).alias("w")))), lambda s: s["w"]).alias("last"))
    return seg.select("lang", "f", F.concat(F.slice(F.split("first", " "), 1, 3), "last").alias("words"))


def _inside(words, f, size: int):
    """All sequences of ``size`` words inside a path or phrase, with its weight."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.struct(
        F.array_join(F.slice(words, i, size), " ").alias("phrase"), f.alias("f")))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 30, cover_percent: int = 80,
                 top: int = 2000, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of every language.

    Texts have A-Z lower-cased and are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at blanks and
    tabs. a: occurrences of the phrase within pieces, ``min_count`` or more; l and r: those of the two parts that the
    weakest cut leaves; n: words of the language; score: floor(2000000 a / (l + r)). A phrase inside a longer
    one with ``min_count`` occurrences is left out where that occurs at least ``cover_percent`` % as often.

    A null text has no words, a null language is ``und``; repeated rows count each time; equal scores are ordered by
    falling a, then phrase (UTF-8 bytes). An empty table, or one without frequent phrases, gives no rows. Other
    columns are not read. Scratch tables lie in the checkpoint folder of the session, which whoever owns it empties.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    flows = gram_flows(docs, text, lang, min_count, scratch, bits)
    counts = phrase_counts(flows, min_count, scratch)
    cand = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    # Covered phrases: those inside paths of four-word edges, or inside three-word phrases, of enough weight.
    paths = compact_paths(counts.where(F.col("k") == LONGEST), scratch)
    inner = paths.select("lang", F.explode(F.concat(_inside(F.col("words"), F.col("f"), 2), _inside(F.col("words"), F.col("f"), 3))).alias("s"))
    three = counts.where("k = 3").select("lang", F.explode(_inside(F.split("phrase", " "), F.col("f"), 2)).alias("s"))
    longer = inner.unionByName(three).groupBy("lang", "s.phrase").agg(F.max("s.f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = cand.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover_percent)).drop("longer")
    # Every cut of a phrase, with the counts of both parts.
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", _cut("phrase", F.col("cut"))).withColumn(
        "right", _cut("phrase", F.col("cut") - F.col("k")))
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast((cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    totals = flows.where("k = 0").select("lang", F.col("c").alias("n"))
    scored = scored.join(totals, "lang").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
