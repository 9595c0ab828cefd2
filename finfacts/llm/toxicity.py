"""Toxicity by nearest labelled examples: TF-IDF cosine over all their words and some chosen terms, calibrated votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, only_cache_of, ship, without

_WORD = re.compile(r"\w+")
MAX_EXAMPLES = 4000     # labelled examples of either class that the model is fitted on (bound of the driver's part)
MAX_TERMS = 256         # chosen terms, which weigh as much as all words together
_CANDIDATES = 2000      # terms that enter the choice
_MIN_GAIN = 16.0        # log-likelihood ratio of a term over the examples not yet explained
_EXPLAINED = 3          # chosen terms after which an example is explained
_PREFIX = range(3, 9)   # lengths of word beginnings that are terms besides the whole words
_HEAD = _PREFIX.start   # letters that a word shares with all its beginnings
_KNOWN = 100_000
_ASCII = {k: chr(k).lower() if _WORD.match(chr(k)) else " " for k in range(128)}
BLOCK = 64              # examples that share a maximum
_COMMON = 16            # a term in more than one of so many examples has a row over all of them
_BATCH = 64             # texts that are scored together
NEIGHBOURS = 15
_SCORED = "score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>"


def features(word: str) -> list[str]:
    """The word and its beginnings, which catch inflected and compound forms."""
    return [word, *(word[:k] + "*" for k in _PREFIX if k < len(word))]


def words_of(text: str) -> list[str]:
    """Lower-case words; ASCII texts, where ``\\w`` is letters, digits and the underscore, are split without the expression."""
    if text.isascii():
        return text.translate(_ASCII).split()
    return _WORD.findall(text.lower())


class Lexicon(dict):
    """Chosen terms of a word, as positions; remembers words seen lately (bounded)."""

    def __init__(self, terms: dict[str, int], words: dict[str, int] | None = None):
        self.terms, self.words = terms, words or {}
        self.heads = {t[:_HEAD] for t in terms}     # a word that begins otherwise has no term

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KNOWN:
            self.clear()
        got = self[word] = tuple(t for t in map(self.terms.get, features(word)) if t is not None)
        return got

    def terms_of(self, words: Iterable[str]) -> set[int]:
        return {t for w in words if w[:_HEAD] in self.heads for t in self[w]}

    def count(self, text: str | None) -> "Counts":
        words = Counter(words_of(text)) if text else {}
        tf, rest, heads = Counter(), sum(words.values()), self.heads
        for w in [w for w in words if w[:_HEAD] in heads]:
            hits = self[w]
            for t in hits:
                tf[t] += words[w]
            if hits:
                rest -= words[w]
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        times = np.fromiter(words.values(), float, len(words))
        known = ids >= 0
        return Counts(tf, rest, ids[known], times[known], times[~known])


@dataclass
class Counts:
    terms: Counter              # frequency of each chosen term
    rest: int                   # words without any
    words: np.ndarray           # positions of the words that some example holds
    times: np.ndarray           # and their frequency
    strange: np.ndarray         # frequencies of the words that no example holds


Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]      # terms and their weights


def _arrays(v: Vector) -> tuple[np.ndarray, np.ndarray]:
    return (np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), float, len(v))) if isinstance(v, dict) else v


class BlockMaxIndex:
    """Postings of unit vectors by term. A term of many examples has a row over all of them, zero where it doesn't
    occur; any other has a list. Every example is scored; the maxima of blocks of ``BLOCK`` tell where the best are."""

    def __init__(self, vectors: list[Vector], n_terms: int):
        self.size = -(-len(vectors) // BLOCK) * BLOCK
        n = [len(_arrays(v)[0]) for v in vectors]
        term, weight = (np.concatenate([_arrays(v)[k] for v in vectors]) for k in (0, 1))
        place = np.repeat(np.arange(len(vectors), dtype=np.int32), n)
        held = np.bincount(term, minlength=n_terms)
        common = held * _COMMON > len(vectors)
        self.row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self.rows = np.zeros((int(common.sum()), self.size))
        dense = common[term]
        self.rows[self.row[term[dense]], place[dense]] = weight[dense]
        rare = np.flatnonzero(~dense).astype(np.int32)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.place, self.weight = place[rare], weight[rare]
        self.start = np.concatenate([[0], np.cumsum(np.where(common, 0, held))])

    def nearest(self, vector: Vector, k: int) -> list[tuple[float, int]]:
        return self.nearest_of([vector], k)[0]

    def nearest_of(self, vectors: list[Vector], k: int) -> list[list[tuple[float, int]]]:
        """Of each vector the k best (cosine, example) above 0, exactly; ties go to the lower example."""
        out = []
        for s in range(0, len(vectors), _BATCH):
            part = vectors[s:s + _BATCH]
            dense, sparse = np.zeros((len(part), len(self.rows))), []
            for q, (terms, weights) in enumerate(map(_arrays, part)):
                row = self.row[terms]
                dense[q, row[row >= 0]] = weights[row >= 0]
                sparse.append((terms[row < 0], weights[row < 0]))
            scores = dense @ self.rows
            for score, (terms, weights) in zip(scores, sparse):
                lo = self.start[terms]
                n = self.start[terms + 1] - lo
                at = np.repeat(lo - np.cumsum(n) + n, n)
                at += np.arange(len(at))
                more = self.weight.take(at, mode="clip")
                more *= np.repeat(weights, n)
                score += np.bincount(self.place.take(at, mode="clip"), more, self.size)
            # The k-th best maximum is no more than the k-th best score, so an example below it is none of the k.
            top = scores.reshape(len(part), -1, BLOCK).max(2)
            least = np.partition(top, -k, axis=1)[:, -k] if top.shape[1] > k else np.zeros(len(part))
            at = np.flatnonzero(scores >= least[:, None] - 1e-11)
            found = np.round(scores.ravel()[at], 12)
            ends = np.searchsorted(at, np.arange(len(part) + 1) * self.size).tolist()
            for q, (i, j) in enumerate(zip(ends, ends[1:])):
                score, place = found[i:j], at[i:j] - q * self.size
                best = np.flatnonzero((score >= np.partition(score, -k)[-k]) & (score > 0)) if len(score) > k else np.flatnonzero(score > 0)
                best = best[np.lexsort((place[best], -score[best]))][:k]
                out.append(list(zip(score[best].tolist(), place[best].tolist())))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted increasing fit of y on x (pool adjacent violators), as points to interpolate between."""
    pools: list[list[float]] = []
    for k in np.argsort(x, kind="stable"):
        pools.append([x[k] * w[k], y[k] * w[k], w[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.empty(0))     # of the terms, of the rest (1), of the words
    strange: float = 0.0        # idf of a word that no example holds
    index: BlockMaxIndex | None = None
    examples: list[tuple[int, int, float]] = field(default_factory=list)    # doc_id, toxic, weight of its class
    curves: dict[bool, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)     # of texts with and without chosen terms
    plain: float = 0.0          # rate of toxic examples

    def unit(self, c: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of two TF-IDF vectors of equal length: over all words, and over the chosen terms if there are
        any. With those, all words without a term are one, which every document has (idf 1), so that one hit in a
        long text isn't as near to an example as many in a short one. Words of no example only add to the length."""
        own = {t: (1 + np.log(n)) * self.idf[t] for t, n in sorted(c.terms.items())}
        if own and c.rest:
            own[len(self.terms)] = 1 + np.log(c.rest)
        order = np.argsort(c.words)
        place = c.words[order] + len(self.terms) + 1
        w = (1 + np.log(c.times[order])) * self.idf[place]
        strange = (1 + np.log(c.strange)) * self.strange
        norm = np.sqrt(w @ w + np.sum(np.sort(strange) ** 2)) * (np.sqrt(2) if own else 1)
        length = float(np.sqrt(2 * sum(x * x for x in own.values())))
        terms, weights = _arrays(own)
        return np.concatenate([terms, place]).astype(np.int32), np.concatenate([weights / (length or 1), w / (norm or 1)])

    def vote(self, near: list[tuple[float, int]], chosen: bool) -> float:
        """Share of toxic votes; a neighbour's weight falls with its distance (steeply where only words in general
        tell, of which far texts share some too) and follows its class in the corpus."""
        w = np.array([self.examples[i][2] / ((1.1 - c) if chosen else (1.02 - c) ** 3) for c, i in near])
        return float(w @ [self.examples[i][1] for _, i in near] / w.sum())

    def scores(self, counts: list[Counts]) -> list[tuple[float, list[tuple[float, int]]]]:
        if self.index is None:
            return [(self.plain, [])] * len(counts)
        found = self.index.nearest_of([self.unit(c) for c in counts], NEIGHBOURS)
        return [(float(np.clip(np.interp(self.vote(near, bool(c.terms)), *self.curves[bool(c.terms)]), 0, 1)) if near else self.plain, near)
                for c, near in zip(counts, found)]


def _choose_terms(names: list[str], present: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Terms by sequential covering: the term that tells the classes best among the examples not yet explained.

    Terms that only travel with stronger ones (say, in copies of one toxic text) are passed over this way. Of terms
    that begin one another only one is taken.
    """
    def ratio(a, b, n, m):     # log-likelihood ratio of a of n toxic and b of m clean examples
        with np.errstate(divide="ignore", invalid="ignore"):
            e = [(a + b) * n / (n + m), (a + b) * m / (n + m), (n + m - a - b) * n / (n + m), (n + m - a - b) * m / (n + m)]
            return 2 * sum(np.where(o > 0, o * np.log(o / x), 0) for o, x in zip((a, b, n - a, m - b), e))

    hits, chosen, free = np.zeros(len(toxic), int), [], np.ones(len(names), bool)
    while len(chosen) < MAX_TERMS:
        t, c = (hits < _EXPLAINED) & toxic, (hits < _EXPLAINED) & ~toxic
        if not t.any() or not c.any():
            break
        gain = np.where(free, ratio(present[t].sum(0).astype(float), present[c].sum(0).astype(float), t.sum(), c.sum()), 0)
        best = int(np.argmax(gain))
        if not gain[best] >= _MIN_GAIN:
            break
        chosen.append(best)
        hits += present[:, best]
        stem = names[best].rstrip("*")
        free &= np.array([not (n.rstrip("*").startswith(stem) or stem.startswith(n.rstrip("*"))) for n in names], bool)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, trains: Column) -> Model:
    """The model from labelled rows that fulfil ``trains`` (an expression over doc_id).

    At most ``MAX_EXAMPLES`` of either class, drawn by a hash of the id, are the examples: this is the documented
    bound of what the driver handles; a repeated id is one example. All their words are weighted and indexed.
    Inverse document frequencies are counted over all documents.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(trains)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return Model(plain=float(1 in count))
    drawn = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EXAMPLES) for c in (0, 1)]
    picked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").where("text is not null")
    picked = picked.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), "toxic")
    picked = Scratch(spark, "toxicity").write(picked, "examples")

    def term_counts(batches):
        total = (Counter(), Counter())
        for b in batch_rows(batches):
            for text, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                total[c].update({f for w in set(words_of(text)) for f in features(w)})
        words = list(total[0].keys() | total[1].keys())
        for s in range(0, len(words), 10_000):
            part = words[s:s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([total[c][w] for w in part], pa.int64()) for c in (0, 1))], names=["term", "clean", "toxic"])

    n = {c: min(count[c], MAX_EXAMPLES) for c in (0, 1)}
    by_term = picked.mapInArrow(term_counts, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gap = F.abs(F.col("toxic") / n[1] - F.col("clean") / n[0]) * F.sqrt(F.col("toxic") + F.col("clean"))
    candidates = [r[0] for r in by_term.where("toxic + clean >= 5").orderBy(gap.desc(), "term").limit(_CANDIDATES).select("term").collect()]
    words = {w: k for k, w in enumerate(sorted(by_term.where("not endswith(term, '*')").select("term").toArrow().column(0).to_pylist()))}
    place = spark.sparkContext.broadcast(({t: k for k, t in enumerate(candidates)}, words))

    def example(batches):
        lexicon = Lexicon(*place.value)
        for b in batch_rows(batches, 2 << 20):
            got = [lexicon.count(x) for x in b.column(1).to_pylist()]
            arrays = [np.array(list(x), t) for c in got for x, t in ((c.terms, np.int64), (c.terms.values(), np.int64), (c.words, np.int32), (c.times, np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([x.tobytes() for x in arrays[k::4]], pa.binary()) for k in range(4)), pa.array([int(c.times.sum()) for c in got], pa.int64())],
                                             names=["doc_id", "toxic", "terms", "counts", "words", "times", "n_words"])

    read = lambda raw, t=np.int64: np.frombuffer(raw, t)     # noqa: E731
    rows = sorted(picked.mapInArrow(example, "doc_id bigint, toxic int, terms binary, counts binary, words binary, times binary, n_words bigint").collect(), key=lambda r: r["doc_id"])
    present = np.zeros((len(rows), max(1, len(candidates))), bool)
    for k, r in enumerate(rows):
        present[k, read(r["terms"])] = True
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    chosen = _choose_terms(candidates, present, toxic)
    model = Model(terms={candidates[c]: k for k, c in enumerate(chosen)}, words=words)
    weight = {c: count[c] / max(1, int((toxic == bool(c)).sum())) for c in (0, 1)}
    place.destroy()
    del present

    shared = spark.sparkContext.broadcast((model.terms, words))

    def frequencies(batches):
        only_cache_of()
        lexicon = Lexicon(*shared.value)
        n_terms = len(lexicon.terms)
        total = np.zeros(n_terms + len(lexicon.words) + 1, np.int64)
        for b in batch_rows(batches):
            held = Counter()        # documents of the batch by word
            for x in b.column(0).to_pylist():
                words = set(words_of(x)) if x else ()
                held.update(words)
                total[list(lexicon.terms_of(words))] += 1
            ids = np.fromiter(map(lexicon.words.get, held, repeat(-1)), np.int64, len(held))
            total[ids[ids >= 0] + n_terms] += np.fromiter(held.values(), np.int64, len(held))[ids >= 0]
            total[-1] += b.num_rows
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["term", "n"])

    df = np.zeros(len(chosen) + len(words) + 1, np.int64)
    counted = docs.select("text").mapInArrow(frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    model.idf = np.insert(np.log((df[-1] + 1) / (df[:-1] + 1)) + 1, len(chosen), 1.0)
    shared.destroy()
    model.strange = float(np.log((df[-1] + 1) / 2) + 1)         # as of a word in one document

    counts, stem = [], model.terms.get
    position = {c: k for k, c in enumerate(chosen)}
    stems = np.array([any(stem(f) is not None for f in features(w)) for w in words], bool)
    for r in rows:
        tf = Counter({position[t]: n for t, n in zip(read(r["terms"]).tolist(), read(r["counts"]).tolist()) if t in position})
        ids, times = read(r["words"], np.int32), read(r["times"], np.int32)
        counts.append(Counts(tf, r["n_words"] - int(times[stems[ids]].sum()), ids, times, np.empty(0)))
    # Examples with like chosen terms share blocks, which keeps the blocks' maxima apart.
    order = sorted((k for k, c in enumerate(counts) if len(c.words)), key=lambda k: (sorted(counts[k].terms, key=lambda t: (-counts[k].terms[t], t)), k))
    vectors = [model.unit(counts[k]) for k in order]
    model.examples = [(rows[k]["doc_id"], rows[k]["toxic"], weight[rows[k]["toxic"]]) for k in order]
    base = count[1] / (count[0] + count[1])
    empty = [(r["toxic"], weight[r["toxic"]]) for r, c in zip(rows, counts) if not len(c.words)]
    has_terms = [bool(counts[k].terms) for k in order]
    del rows, counts            # before the index is built, as the driver's memory is bounded
    model.plain = (sum(y * w for y, w in empty) + base) / (sum(w for _, w in empty) + 1)
    if order:
        model.index = BlockMaxIndex(vectors, len(model.idf))
        # One example of either kind at the ends keeps the curve off 0 and 1; without chosen terms, where few examples
        # may be near one another, a vote that hardly any example has counts as it is.
        votes = {True: [(0, 1, base), (1, 0, 1 - base), (0, 0, 1 - base), (1, 1, base)], False: [(x, x, 1) for x in (0, 0.25, 0.5, 0.75, 1)]}
        for k, near in enumerate(model.index.nearest_of(vectors, NEIGHBOURS + 1)):      # each example is judged by the others
            near = [x for x in near if x[1] != k][:NEIGHBOURS]
            if near:
                votes[has_terms[k]].append((model.vote(near, has_terms[k]), *model.examples[k][1:]))
        model.curves = {c: isotonic(*np.array(v, float).T) for c, v in votes.items()}
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, trains: Column, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``evidence`` (nearest examples).

    The whole text is compared; labels, language, source and id never enter a score. A text that shares no word
    with any example (null and empty ones too) gets the rate of toxic labels among examples without words. Rows are scored one by one
    against a model of bounded size, so repeated rows get equal scores and no key is hot. Labels that are null or
    neither 0 nor 1 are left out, of repeated ones the larger counts; without both classes every score is that of
    the only class, or 0. An empty table stays empty. Input columns of the added names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, trains))
    rows = without(docs, "score", "predicted", "evidence")
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def score(batches):
        only_cache_of()
        m = model.value
        lexicon = Lexicon(m.terms, m.words)
        for b in batch_rows(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            found = [x for k in range(0, len(texts), _BATCH) for x in m.scores([lexicon.count(t) for t in texts[k:k + _BATCH]])]
            evidence = [[{"doc_id": m.examples[i][0], "cosine": c, "toxic": m.examples[i][1]} for c, i in near[:3]] for _, near in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array(evidence, kind)],
                                             names=[*b.schema.names, "score", "predicted", "evidence"])

    return rows.mapInArrow(score, f"{rows.schema.simpleString()[7:-1]},{_SCORED}")
