"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.llm import (decontam, hnsw_dedup, jaccard_join, ngram_lm, packing, phrases, secrets, sharding, topk_blocks, toxicity,
                          urlfilter, warc, whitening)
from finfacts.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                       sharding.text_size(F.col("text")).alias("bytes"))
    out = sharding.shard_by_bytes(rows, ["doc_id", "text_crc32"], F.col("bytes"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.archive_round_trip(table(spark, sf_dir, "pages"), min_revisit=0)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op6_capture_index"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first_page,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, ((5 * i) // 4 + 1)::BIGINT, 2))::BIGINT >> (3 - (5 * i) % 4)::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM d"""


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, "text", secrets.RULES).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans"))


@query
def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"), max_len=1024, end_id=2)


@query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", F.round("score", 9).alias("score"), "first_word", "last_word")


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "n_links", "kept")


def _held_out(mod: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 2, F.lit(False))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), ~_held_out(4), 0.3)
    return out.select("doc_id", _held_out(4).alias("held_out"), "score", "predicted")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.embedding_links(table(spark, sf_dir, "embeddings"), 0.93)


@query
def op4_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_texts(table(spark, sf_dir, "documents"), _held_out(7))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=8, scale=1024, shift=100000)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), "text", "lang", min_count=30, cover_percent=80, top=2000)


ORACLE_SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, w[i:i + k - 1] AS g, k FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, g, k, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, g, k, f FROM counts WHERE k > 1 AND f >= 30
), covered AS (
  SELECT DISTINCT s.lang, s.g FROM cand s JOIN cand b ON b.lang = s.lang AND b.k > s.k AND 100::HUGEINT * b.f >= 80::HUGEINT * s.f
  WHERE list_contains(list_transform(range(1, b.k - s.k + 2), lambda i: b.g[i:i + s.k - 1]), s.g)
), cuts AS (
  SELECT c.lang, c.g, c.k, c.f AS a, unnest(range(1, c.k)) AS cut FROM cand c ANTI JOIN covered v ON v.lang = c.lang AND v.g = c.g
), scored AS (
  SELECT t.lang, t.g, t.a, l.f AS l, r.f AS r, (2000000::HUGEINT * t.a // (l.f + r.f))::BIGINT AS score
  FROM cuts t JOIN counts l ON l.lang = t.lang AND l.g = t.g[1:cut] JOIN counts r ON r.lang = t.lang AND r.g = t.g[cut + 1:t.k]
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.g ORDER BY score, cut) = 1
)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
       a, l, r, n, score
FROM scored s JOIN totals t ON t.lang = s.lang QUALIFY rank <= 2000"""


@query
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_blocks.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", scale=256, k=5)


ORACLE_SQL["op13_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.row ORDER BY list_inner_product(q.w, d.w) DESC, d.vec_id)::INTEGER AS rank,
       d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
FROM v q JOIN v d ON d.row <> q.row WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5"""
