"""Readers for landed filing data.

Every reader returns a DataFrame; files are read by executors (``binaryFile`` /
``text`` sources), never pulled through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.functions.ids import normalize_cik, normalize_ticker, strict_date
from finfacts.functions.payload import canonical_json_sha256, gzip_canonical_json
from finfacts.session import scratch_path

FACTS_NAME = r"^CIK(\d+)\.json$"
OVERFLOW_NAME = r"^CIK(\d+)-submissions-\d+\.json$"


def _files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                               F.col("content"), F.col("modificationTime").alias("mtime")))


def company_facts_files(spark: SparkSession, path: str, ciks: DataFrame | None = None) -> DataFrame:
    """(cik, payload, mtime, sha256) per ``CIK<digits>.json`` file (names with ``-`` are skipped).

    ``ciks`` limits the scan to a company subset (semi-join on the file-name cik).
    The hash is over the raw bytes, the change-detection key of the facts table.
    """
    f = _files(spark, path, "CIK*.json").where(F.col("name").rlike(FACTS_NAME))
    f = f.select(normalize_cik(F.regexp_extract("name", FACTS_NAME, 1)).alias("cik"),
                 F.decode("content", "UTF-8").alias("payload"), "mtime",
                 F.sha2("content", 256).alias("sha256"))
    if ciks is not None:
        f = f.join(ciks.select("cik").distinct(), "cik", "left_semi")
    return f


SUBMISSION_SCHEMA = ("struct<cik:string,name:string,sic:string,sicDescription:string,entityType:string,"
                     "category:string,fiscalYearEnd:string,stateOfIncorporation:string,ein:string,lei:string,"
                     "exchanges:array<string>,tickers:array<string>,"
                     "filings:struct<recent:map<string,array<string>>,files:array<struct<name:string>>>>")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filing metadata per company with overflow files merged.

    Each overflow file listed under ``filings.files`` holds more values for the
    ``filings.recent`` columns; they are appended in listing order. mtime is the
    newest part's. Unparseable files are skipped. Output: (cik, meta
    map<string,string>, exchanges, recent map<string,array<string>>, mtime).
    """
    f = _files(spark, path, "CIK*.json")
    main = f.where(F.col("name").rlike(FACTS_NAME)).select(
        "name", "mtime", F.from_json(F.decode("content", "UTF-8"), SUBMISSION_SCHEMA).alias("d"))
    # Invalid JSON parses to a struct of nulls (partial results); such files are skipped.
    main = main.where(F.col("d.cik").isNotNull() | F.col("d.name").isNotNull() | F.col("d.filings").isNotNull())
    main = main.select(normalize_cik(F.coalesce(F.col("d.cik"), F.regexp_extract("name", FACTS_NAME, 1))).alias("cik"),
                       "mtime", "d")
    over = f.where(F.col("name").rlike(OVERFLOW_NAME)).select(
        F.col("name").alias("oname"), F.col("mtime").alias("omtime"),
        F.from_json(F.decode("content", "UTF-8"), "map<string,array<string>>").alias("extra"))
    listed = main.select("cik", F.posexplode("d.filings.files").alias("pos", "file"))
    parts = listed.join(over, F.col("file.name") == F.col("oname"), "inner")
    per_key = (parts.select("cik", "pos", "omtime", F.explode("extra").alias("key", "arr"))
               .groupBy("cik", "key")
               .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "arr"))), lambda x: x["arr"]))
                    .alias("arr"), F.max("omtime").alias("omtime")))
    extra = per_key.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("key", "arr"))).alias("extra"),
                                       F.max("omtime").alias("omtime"))
    j = main.join(extra, "cik", "left")
    recent = F.map_zip_with(F.coalesce(F.col("d.filings.recent"), F.create_map().cast("map<string,array<string>>")),
                            F.coalesce(F.col("extra"), F.create_map().cast("map<string,array<string>>")),
                            lambda _k, a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")),
                                                      F.coalesce(b, F.array().cast("array<string>"))))
    meta_keys = ["name", "sic", "sicDescription", "entityType", "category", "fiscalYearEnd", "stateOfIncorporation",
                 "ein", "lei"]
    meta = F.create_map(*[x for k in meta_keys for x in (F.lit(k), F.col(f"d.{k}"))])
    out = j.select("cik", meta.alias("meta"), F.col("d.exchanges").alias("exchanges"), recent.alias("recent"),
                   F.greatest("mtime", F.coalesce("omtime", "mtime")).alias("mtime"))
    # Change-detection hash and stored payload over the *merged* document, in
    # canonical JSON (sorted keys), so key order in the files does not matter.
    merged = F.to_json(F.struct("cik", "meta", "exchanges", "recent"))
    return out.withColumn("h", canonical_json_sha256(merged)).withColumn("payload", gzip_canonical_json(merged))


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """``{"0": {"cik_str", "ticker", "title"}, ...}`` -> (cik, ticker, title, rank, is_primary).

    Rows are ordered by their integer key; rank = position (0-based). Tickers are
    upper-cased with ``.`` -> ``-``. The list is one JSON object (about ten
    thousand symbols): one row, exploded on the executor that reads it.
    """
    t = spark.read.option("wholetext", "true").text(path)
    m = F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>")
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].cast("long").alias("k"),
                                                                             e["value"].alias("v"))))
    x = t.select(F.posexplode(entries).alias("rank", "e"))
    return x.select(normalize_cik(F.col("e.v.cik_str")).alias("cik"), normalize_ticker(F.col("e.v.ticker")).alias("ticker"),
                    F.col("e.v.title").alias("title"), F.col("rank").cast("int").alias("rank"),
                    F.lit(True).alias("is_primary"))


def fund_list(spark: SparkSession, path: str) -> DataFrame:
    """``{"fields": [...], "data": [[...], ...]}`` -> (cik, series_id, class_id, symbol); the first
    row of a class wins. Columns are located by name in ``fields``."""
    t = spark.read.option("wholetext", "true").text(path)
    d = t.select(F.from_json("value", "struct<fields:array<string>,data:array<array<string>>>").alias("d"))
    rows = d.select("d.fields", F.posexplode("d.data").alias("pos", "row"))

    def field(name: str):
        return F.element_at(F.col("row"), F.array_position(F.col("fields"), name).cast("int"))
    r = rows.where(F.array_position("fields", "classId") > 0).select(
        "pos", normalize_cik(field("cik")).alias("cik"), field("seriesId").alias("series_id"),
        field("classId").alias("class_id"), normalize_ticker(field("symbol")).alias("symbol"))
    first = r.groupBy("class_id").agg(F.min_by(F.struct("cik", "series_id", "symbol"), "pos").alias("f"))
    return first.select(F.col("f.cik").alias("cik"), F.col("f.series_id").alias("series_id"), "class_id",
                        F.col("f.symbol").alias("symbol"))


def entity_names(spark: SparkSession, path: str) -> DataFrame:
    """Latin-1 lines ``NAME:CIK:`` -> (cik, entity_name); the name may contain colons
    (split at the last one before the cik). Not unique on (cik, name)."""
    # The CSV reader honours the encoding and splits large files by line; a
    # separator that never occurs and no quoting keep each line whole.
    t = (spark.read.schema("value string").option("encoding", "ISO-8859-1").option("sep", "\u0001")
         .option("quote", "").option("header", "false").csv(path))
    line = F.regexp_replace("value", ":+$", "")
    pat = r"^(.*):([^:]*)$"
    x = t.select(F.regexp_extract(line, pat, 1).alias("entity_name"),
                 normalize_cik(F.regexp_extract(line, pat, 2)).alias("cik"))
    return x.where(F.col("cik").isNotNull() & (F.col("entity_name") != ""))


FX_XML_SCHEMA = ("struct<Cube:struct<Cube:array<struct<_time:string,"
                 "Cube:array<struct<_currency:string,_rate:string>>>>>>")


def fx_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Reference-rate XML (daily ``Cube time=...`` holding ``Cube currency rate``) ->
    (rate_date, currency, rate) per EUR. Unparseable dates and rates are dropped."""
    t = spark.read.option("wholetext", "true").text(path)
    x = t.select(F.from_xml("value", FX_XML_SCHEMA).alias("x"))
    days = x.select(F.explode("x.Cube.Cube").alias("day"))
    q = days.select(strict_date(F.col("day._time")).alias("rate_date"),
                    F.explode("day.Cube").alias("c"))
    return (q.select("rate_date", F.col("c._currency").alias("currency"),
                     F.expr("try_cast(c._rate AS DOUBLE)").alias("rate"))
             .where(F.col("rate_date").isNotNull() & F.col("currency").isNotNull() & F.col("rate").isNotNull()))


def csv_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header and declared types; empty field = null; ``"`` quotes and escapes."""
    return (spark.read.schema(schema).option("header", "true").option("nullValue", "").option("quote", '"')
            .option("escape", '"').option("multiLine", "true").csv(path))


def sic_rules(spark: SparkSession, path: str) -> DataFrame:
    """CSV (code, sector, industry) of SIC prefixes of 2 to 4 digits -> rules for ``classify``.

    The complete mapping has hundreds of rows, so it is a file that the user names; the package holds a small one.
    """
    t = csv_table(spark, path, "code string, sector string, industry string").where(F.trim("code").rlike("^[0-9]{2,4}$"))
    return t.select(F.length(F.trim("code")).alias("level"), F.trim("code").cast("int").alias("prefix"), "sector", "industry")


def jdbc_table(spark: SparkSession, url: str, table: str, properties: dict, cik_ranges: list[tuple[str, str]] | None = None,
               fetchsize: int = 50000) -> DataFrame:
    """Table from a JDBC store, 50,000-row fetches; ``cik_ranges`` become one partition each
    (parallel reads without a numeric partition column)."""
    props = dict(properties, fetchsize=str(fetchsize))
    if cik_ranges:
        preds = [f"cik >= '{lo}' AND cik < '{hi}'" for lo, hi in cik_ranges]
        return spark.read.jdbc(url, table, predicates=preds, properties=props)
    return spark.read.jdbc(url, table, properties=props)


def keyed_slice(df: DataFrame, ciks: DataFrame) -> DataFrame:
    """Rows of the chosen companies only (replaces IN-lists and keyset paging)."""
    return df.join(ciks.select("cik").distinct(), "cik", "left_semi")


def statement_tag_rules(schemas: DataFrame) -> DataFrame:
    """(statement, json) statement schema documents -> distinct (statement, namespace, tag) rules.

    Every ``xbrl_tags`` list at any depth is read: items are objects with ``namespace`` and a text ``tag``, or texts
    ``namespace:tag``. Only us-gaap and ifrs-full tags count; other items and values of the key are skipped, and so is
    a document that is no JSON. The walk goes down the documents' values level by level, each written to the checkpoint
    folder, so the number of values has no bound (a recursive query ends at ``spark.sql.cteRecursionRowLimit``).
    """
    spark = schemas.sparkSession
    base = scratch_path(spark, f"tag-rules-{uuid.uuid4().hex[:12]}")
    level = schemas.select("statement", F.lit(None).cast("string").alias("key"), F.try_parse_json("json").alias("v"), F.lit(False).alias("listed"))
    paths = []
    while not paths or not level.isEmpty():
        below = spark.sql("""SELECT n.statement, c.key, c.value AS v, coalesce(n.key = 'xbrl_tags', false) AND c.key IS NULL AS listed
                             FROM {level} n, LATERAL variant_explode(n.v) c""", level=level)
        paths.append(f"{base}/{len(paths)}")
        below.write.parquet(paths[-1])
        level = spark.read.schema(below.schema).parquet(paths[-1])
    return spark.sql("""
        WITH tagged AS (
          SELECT statement, CASE WHEN schema_of_variant(v) = 'STRING' THEN split_part(CAST(v AS STRING), ':', 1)
                                 WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN try_variant_get(v, '$.namespace', 'string') END AS namespace,
                 CASE WHEN schema_of_variant(v) = 'STRING' AND CAST(v AS STRING) LIKE '%:%' THEN substring(CAST(v AS STRING), instr(CAST(v AS STRING), ':') + 1)
                      WHEN schema_of_variant(v) LIKE 'OBJECT%' AND schema_of_variant(try_variant_get(v, '$.tag', 'variant')) = 'STRING'
                      THEN try_variant_get(v, '$.tag', 'string') END AS tag
          FROM {values} WHERE listed)
        SELECT DISTINCT statement, namespace, tag FROM tagged WHERE namespace IN ('us-gaap', 'ifrs-full') AND tag IS NOT NULL""",
                     values=spark.read.schema(level.schema).parquet(*paths))
