"""Cleaning pipeline over ``documents``: toxicity, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Stages see all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finfacts.llm import decontam, jaccard_join, packing, secrets, toxicity
from finfacts.llm.common import Scratch, table


def _row_key(text_key: Column) -> Column:
    """One number for a row's id and text; nulls count as values."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_key)


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but id and text under private names, which no operator adds or replaces, and the
    columns that give them back their own."""
    private = {c: f"__col{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(private), [F.col(private.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3, by the model that the labels of ``sf_dir`` give.

    Null and empty texts get the score of texts without words, repeated rows equal scores; other columns pass through
    as they are, whatever their names.
    """
    rows, back = _aside(docs)
    return toxicity.score_toxicity(rows, table(spark, sf_dir, "labels"), F.lit(True), 0.3).where("predicted = 0").select(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Rows that repeat both id and text are one document, any of which
    stays. Texts without words (null, empty, blank) are no duplicates of another id; other columns pass through."""
    rows, back = _aside(docs)
    kept = jaccard_join.near_duplicates(rows.select("doc_id", "text")).where("kept").select(_row_key(F.col("text_key")).alias("__key")).distinct()
    single = rows.withColumn("__key", _row_key(F.xxhash64("text"))).dropDuplicates(["__key"])
    return single.join(kept, "__key", "left_semi").select(back)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts have none; repeated rows go or stay
    together; other columns pass through."""
    rows, back = _aside(docs)
    hits = decontam.find_leaks(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaky = hits.select(_row_key(F.col("text_key")).alias("__key")).distinct()
    return rows.withColumn("__key", _row_key(F.xxhash64("text"))).join(leaky, "__key", "left_anti").select(back)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets; a numeric ``n_chars`` follows a changed text. Null
    and empty texts stay, repeated rows are changed alike, other columns pass through."""
    rows, back = _aside(docs)
    found = secrets.scan_secrets(rows)
    found = found.withColumn("__text", secrets.redact(F.col("text"), F.col("secrets")))
    out = dict(zip(docs.columns, back)) | {"text": F.col("__text").alias("text")}
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.NumericType):
        out["n_chars"] = F.when(F.size("secrets") > 0, F.length("__text")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*out.values())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset; null and empty texts are an end alone."""
    return packing.pack_best_fit(docs, max_len=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Models, MinHash and a tokenizer aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
