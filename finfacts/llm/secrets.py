"""Secret scanning: Boolean trigram queries per rule over a block's trigram inverted index, then verification."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import batch_rows, only_cache_of, ship, without


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; a match whose ``group`` is shorter than ``min_len`` characters is dropped."""
    kind: str
    pattern: str
    min_len: int = 0
    group: int = 0


#: The base rules come first; their order is the order of kinds at equal starts.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),      # the whole runs that [0-9a-f]+ finds, without the short ones
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("hosted_git", r"(?:ghp|gho|ghs|ghu|ghr|github_pat)_[A-Za-z0-9_]+", 24),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE_RULES + EXTRA_RULES
MATCHES = "array<struct<kind:string,start:int,end:int,secret:string>>"
_MAX_EXACT = 64         # alternatives of one literal run that are followed before the run is closed


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Trigrams that any match must contain, in lower case: an AND of ORs of ANDs; [] if none is mandatory.

    The pattern's syntax tree is walked once. Runs of elements with few possible texts (literals, small sets,
    options, alternatives) are multiplied out; where a run ends, every one of its texts contributes an alternative,
    and the run is a condition only if all its texts are three characters or longer.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(texts: set[str]) -> None:
        if texts and min(map(len, texts)) >= 3:
            clauses.append(sorted({frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts}, key=sorted))

    def options(op, av) -> set[str] | None:
        """All texts of one element, or None if there are too many."""
        if op is C.LITERAL:
            return {chr(av).lower()}
        if op is C.IN:
            chars = set()
            for o, a in av:
                if o is C.LITERAL:
                    chars.add(chr(a).lower())
                elif o is C.RANGE and a[1] - a[0] < 8:
                    chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is C.SUBPATTERN:
            return product(av[3])
        if op is C.BRANCH:
            parts = [product(b) for b in av[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[1] <= 1:
            inner = product(av[2])
            return None if inner is None else inner | ({""} if av[0] == 0 else set())
        return None

    def product(seq) -> set[str] | None:
        texts = {""}
        for op, av in seq:
            if op is C.AT:
                continue
            more = options(op, av)
            if more is None or len(texts) * len(more) > _MAX_EXACT:
                return None
            texts = {a + b for a in texts for b in more}
        return texts

    def walk(seq) -> None:
        run = {""}
        for op, av in seq:
            if op is C.AT:
                continue
            more = options(op, av)
            if more is not None and len(run) * len(more) <= _MAX_EXACT:
                run = {a + b for a in run for b in more}
                continue
            close(run)
            run = {""}
            if more is not None:
                run = more
            elif op is C.SUBPATTERN:
                walk(av[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] >= 1:
                walk(av[2])
        close(run)

    walk(parser.parse(pattern))
    return clauses


class TrigramIndex:
    """Inverted index of one block of texts: trigram -> ordinals of the texts that hold it (ASCII case folded).

    Only trigrams that the rules ask for get postings; their number depends on the rules, not on the data.
    """

    def __init__(self, texts: list[bytes], wanted: list[str]):
        ends = np.cumsum([len(t) + 3 for t in texts])
        raw = np.frombuffer(b"\0\0\0".join([*texts, b""]).lower(), np.uint8)
        self.postings: dict[str, set[int]] = {t: set() for t in wanted}
        if len(raw) < 3 or not wanted:
            return
        codes = raw[:-2].astype(np.uint32) << 16
        codes |= raw[1:-1].astype(np.uint32) << 8
        codes |= raw[2:]
        mark = np.zeros(1 << 24, bool)
        by_code = {int.from_bytes(t.encode(), "big"): t for t in wanted}
        mark[list(by_code)] = True
        at = np.flatnonzero(mark[codes])
        for code, doc in np.unique(np.stack([codes[at], np.searchsorted(ends, at, "right")], 1), axis=0).tolist():
            self.postings[by_code[code]].add(doc)

    def candidates(self, query: list[list[frozenset[str]]]) -> set[int]:
        """Ordinals that satisfy the Boolean query: intersect postings, smallest first."""
        found: set[int] | None = None
        for clause in query:
            either: set[int] = set()
            for every in clause:
                lists = sorted((self.postings[t] for t in every), key=len)
                either |= lists[0].intersection(*lists[1:])
            found = either if found is None else found & either
        return found or set()


def find_secrets(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, end, text) per text, by start, then rule order; starts and ends count code points."""
    # Trigrams with non-ASCII characters aren't indexed; a rule that needs one scans fully.
    queries = [q if all(t.isascii() for c in q for e in c for t in e) else [] for q in (trigram_query(r.pattern) for r in rules)]
    wanted = sorted({t for q in queries for clause in q for every in clause for t in every})
    index = TrigramIndex([t.encode("utf-8", "surrogatepass") for t in texts], wanted)
    out: list[list[tuple[str, int, int, str]]] = [[] for _ in texts]
    for rule, q in zip(rules, queries):
        find = re.compile(rule.pattern).finditer
        for i in (sorted(index.candidates(q)) if q else range(len(texts))):
            out[i] += [(rule.kind, *m.span(), m.group()) for m in find(texts[i])
                       if m.end(rule.group) - m.start(rule.group) >= rule.min_len]
    order = {r.kind: k for k, r in enumerate(rules)}
    for spans in out:
        spans.sort(key=lambda s: (s[1], order[s[0]]))
    return out


def scan_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, block_bytes: int = 8 << 20) -> DataFrame:
    """``df`` with ``secrets``: every match of every rule in the whole text, by start, then rule order.

    Each task indexes its rows block by block, so memory is bounded by ``block_bytes`` (a larger single text is a
    block of its own), nothing is shuffled and a lost task is simply run again. A hot source or a group of copies
    costs no more than other rows. Null and empty texts have no matches; repeated rows are scanned one by one; an
    empty table stays empty; an input column ``secrets`` is replaced.
    """
    ship(df.sparkSession)
    rows = without(df, "secrets")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))

    def scan(batches):
        only_cache_of()
        for b in batch_rows(batches, block_bytes):
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            found = find_secrets([t or "" for t in texts], rules)
            cells = [[{"kind": k, "start": s, "end": e, "secret": x} for k, s, e, x in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, kind)], names=[*b.schema.names, "secrets"])

    return rows.mapInArrow(scan, rows.schema.simpleString()[7:-1] + f",secrets:{MATCHES}")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, secrets: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; spans that overlap an earlier one are merged into it."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        secrets, start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, done).otherwise(text)
