"""Benchmark decontamination: shared word pairs propose passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, only_cache_of, ship

_WORD = re.compile(r"\w+")
SEED = 2                # words of an n-gram; with pairs the count filter of ``Items`` loses nothing
MIN_WORDS = 5           # shorter items are too little evidence and are left out
MIN_SCORE = 0.5
BLOCK_BYTES = 4 << 20   # benchmark text that one broadcast holds
_HITS = "doc_id bigint, text_key bigint, item_id bigint, score double, first_word int, last_word int, passage string"


class Items:
    """A block of benchmark items: vocabulary, word ids, and which items hold which word pair.

    An alignment with m matches and e edits scores m - e and has at most e + 1 runs of matches, so it holds at least
    m - e - 1 word pairs of the item unbroken. One that reaches ``MIN_SCORE`` of n words therefore holds
    ``pairs`` = ceil(MIN_SCORE * n) - 1 of them, on at most ``span`` words of the text.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in rows:
            words = _WORD.findall(text.lower())
            if len(words) >= MIN_WORDS:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.base = len(self.vocabulary) + 1
        if self.base**SEED >= 1 << 63:
            raise ValueError("a benchmark block has too many different words")
        self.own = [np.unique(self.codes(w)) for w in self.words]
        least = [math.ceil(MIN_SCORE * len(w)) for w in self.words]
        self.pairs = np.array([x - 1 for x in least], np.int64)
        self.span = [2 * len(w) - x for w, x in zip(self.words, least)]
        code = np.concatenate(self.own) if self.own else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.repeat(np.arange(len(self.own)), [len(g) for g in self.own])[order]

    def codes(self, words: np.ndarray) -> np.ndarray:
        """One exact number an n-gram; 0 where a word isn't in the block's vocabulary."""
        n = len(words) - SEED + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED):
            out = out * self.base + words[k:k + n]
            known &= words[k:k + n] > 0
        return np.where(known, out, 0)

    def word_ids(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in _WORD.findall(text.lower())], np.int64)

    def candidates(self, codes: np.ndarray) -> list[int]:
        """Items of which a text with these n-grams holds enough word pairs, wherever they stand."""
        own, times = np.unique(codes[codes > 0], return_counts=True)
        lo = np.searchsorted(self.code, own, "left")
        n = np.searchsorted(self.code, own, "right") - lo
        if not n.any():
            return []
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        held = np.bincount(self.item[k], np.repeat(times, n), len(self.ids))
        return np.flatnonzero(held >= self.pairs).tolist()

    def windows(self, i: int, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where an alignment of item ``i`` can lie: around each ``pairs`` consecutive pairs that stand near enough."""
        at = np.flatnonzero(np.isin(codes, self.own[i]))
        first, last = at[:len(at) - self.pairs[i] + 1], at[self.pairs[i] - 1:]
        near = last - first <= self.span[i] - SEED
        yield from zip(np.maximum(last[near] + SEED - self.span[i], 0).tolist(), np.minimum(first[near] + self.span[i], len(codes) + SEED - 1).tolist())


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_BYTES`` (a larger item is a block); the driver holds one at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col(f"`{item_id}`").cast("long"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).toLocalIterator():
        n = len(r[1].encode("utf-8", "surrogatepass"))
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words (match 1, mismatch -1, gap -1) for each pair: best score, and the last word of it
    in the item and in the window. Rows of all pairs advance together; the gap along a row is a running maximum."""
    n, rows, cols = len(items), max(map(len, items)), max(map(len, windows))
    a, b = np.full((n, rows), -1, np.int64), np.full((n, cols), -2, np.int64)
    for k in range(n):
        a[k, :len(items[k])] = items[k]
        b[k, :len(windows[k])] = windows[k]
    step = np.arange(cols, dtype=np.int32)
    prev = np.zeros((n, cols + 1), np.int32)
    best, end_item, end_window = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in range(rows):
        same = (a[:, r:r + 1] == b) & (b > 0)
        score = np.maximum(np.maximum(prev[:, :-1] + np.where(same, 1, -1), prev[:, 1:] - 1), 0).astype(np.int32)
        row = np.maximum.accumulate(score + step, axis=1) - step
        top = row.max(1)
        up = top > best
        best[up], end_item[up], end_window[up] = top[up], r, row.argmax(1)[up]
        prev[:, 1:] = row
    return best, end_item, end_window


def find_in(items: Items, docs: list[tuple[int, str, int]]) -> Iterator[tuple]:
    """Hits in some documents; windows of one item that overlap are one window."""
    found = []
    for d, (_, text, _) in enumerate(docs):
        ids = items.word_ids(text)
        codes = items.codes(ids)
        for i in items.candidates(codes):
            last = None
            for lo, hi in items.windows(i, codes):
                if last and lo <= last[3] and hi - last[2] <= 8 * len(items.words[i]):
                    last[3] = max(hi, last[3])
                else:
                    last = [d, i, lo, hi, ids]
                    found.append(last)
    found.sort(key=lambda f: f[3] - f[2])        # windows of like length share a batch
    best: dict[tuple[int, int], tuple] = {}
    s = 0
    while s < len(found):
        n = 256
        while n > 1 and n * (found[min(s + n, len(found)) - 1][3] - found[min(s + n, len(found)) - 1][2]) > 1 << 20:
            n //= 2                                                      # bounds what an alignment holds
        part, s = found[s:s + n], s + n
        score, end_i, end_w = align([items.words[f[1]] for f in part], [f[4][f[2]:f[3]] for f in part])
        for f, x, ei, ew in zip(part, score.tolist(), end_i.tolist(), end_w.tolist()):
            ratio, key = x / len(items.words[f[1]]), (f[0], f[1])
            if ratio >= MIN_SCORE and (key not in best or (ratio, -f[2]) > best[key][:2]):
                best[key] = (ratio, -f[2], f, ei, ew)
    for (d, i), (ratio, _, f, ei, ew) in best.items():
        # Where the alignment begins: its reverse, from its last words back.
        _, _, back = align([items.words[i][ei::-1]], [f[4][f[2]:f[2] + ew + 1][::-1]])
        first, end = f[2] + ew - int(back[0]), f[2] + ew + 1
        # Whitespace and punctuation between the words belong to the passage.
        spans = [m.span() for k, m in enumerate(_WORD.finditer(docs[d][1].lower())) if k in (first, end - 1)]
        passage = docs[d][1][spans[0][0]:spans[-1][1]] if len(docs[d][1].lower()) == len(docs[d][1]) else None
        yield docs[d][0], docs[d][2], items.ids[i], ratio, first, end, passage


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, text_key (64-bit hash of the text, for
    joining back), item_id, score, first_word, last_word (end exclusive), passage.

    Words are runs of letters and digits in lower case. The score is that of the best local alignment, over the
    item's words: 1 for a verbatim copy; a pair counts from ``MIN_SCORE`` on, half the item as it were. The
    benchmark is a stated query set and meets all documents in blocks of bounded size. One pass for each block counts
    the word pairs that a document shares with each item and aligns the item with every window that holds as many as
    a score of ``MIN_SCORE`` needs, so the pairs found are those that aligning everything would find. Nothing is
    shuffled, so a document or an item that occurs everywhere is no hot key; a very long document costs its own length.

    Null and empty texts hold nothing; null items and those under ``MIN_WORDS`` words are left out. Repeated rows
    are found each for itself. Ties go to the earlier passage. ``passage`` is null where lower case changes a
    text's length. Empty tables give no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "find_leaks")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.xxhash64(F.col(f"`{text}`")).alias("text_key")).where("text is not null")
    out = None
    for number, block in enumerate(blocks(benchmark, item_id, item_text)):
        items = Items(block)
        if not items.ids:
            continue
        shared = spark.sparkContext.broadcast(items)

        def find(batches, shared=shared):
            only_cache_of()
            for b in batch_rows(batches):
                hits = list(find_in(shared.value, list(zip(*(c.to_pylist() for c in b.columns)))))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
                cols = list(zip(*hits)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _HITS.split(", ")])

        hits = scratch.write(rows.mapInArrow(find, _HITS), f"hits_{number}")
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], _HITS)
