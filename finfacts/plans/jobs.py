"""Batch jobs that build and refresh the store.

Each job reads landed files, runs DataFrame operators and publishes one version of a ``Store``; intermediate results
are written, not held, so a lost executor only recomputes from the last written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finfacts.functions.ids import normalize_cik, normalize_ticker
from finfacts.operators import classify as cl
from finfacts.operators import delta as dl
from finfacts.operators import facts as fa
from finfacts.operators import fx
from finfacts.operators import statements as st
from finfacts.operators.dictionaries import dictionary_delta
from finfacts.operators.incremental import COMPANY_TABLES, company_tables, presentation_of
from finfacts.operators.standardize import ttm
from finfacts.sinks import export as ex
from finfacts.sources import filings
from finfacts.store import BUCKETS, Commit, Store


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed projection: exactly the declared columns, cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def latest_table(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """A table at the store's latest version, None if there is none."""
    return Store(spark, store).table(name)


def _facts_of(files: DataFrame) -> DataFrame:
    """Fact rows of landed files (cik, payload, load_seq); a row's company is that of its file, as the file is what changes."""
    f = fa.explode_company_facts(files.select("payload", F.struct("cik", "load_seq").alias("file")), "payload", doc_id="file")
    return f.withColumn("cik", F.col("file.cik")).withColumn("load_seq", F.col("file.load_seq")).drop("file")


def _dictionaries(commit: Commit, new_facts: DataFrame) -> None:
    """Dictionaries grown by the keys that they don't hold yet; texts first seen stay."""
    for name, cols, attrs in (("xbrl_tags", ["namespace", "tag"], ["label", "description"]), ("accessions", ["accn"], [])):
        rows = new_facts.where(F.col("accn").isNotNull()) if name == "accessions" else new_facts
        commit.overwrite(name, dictionary_delta(commit.base.table(name), rows, cols, attrs, "load_seq"), key=None)


def apply_company_files(base: Store, files: DataFrame, rules: DataFrame | None, std_rules: DataFrame | None = None, definitions: DataFrame | None = None,
                        complete: bool = False, version: int | None = None, limit: int | None = None, force: bool = False) -> int:
    """Bring the store up to date with company files (cik, payload, h, load_seq); returns the number of changed companies.

    A file counts by the hash last seen for its company, whether it had facts or not, so the same files again change
    nothing. All tables that follow from the changed companies' facts are replaced for these companies, in the buckets
    that they fall into, and published as one version. With ``complete``, the files are all there are, and companies
    without a file go. A derived table that the store doesn't have yet is built in full.
    """
    spark, commit = base.spark, base.begin(version)
    seen = base.table("files_seen")
    if seen is None:
        seen = spark.createDataFrame([], "cik string, h string")
    listed = files.select("cik", "h")
    status = dl.classify_changes(listed, seen)
    if complete:
        status = status.unionByName(seen.join(listed, "cik", "left_anti").select("cik", F.lit("vanished").alias("status")))
    status = commit.stage("changed", status.where("status <> 'unchanged'"))
    keys = status.select("cik")
    n = dl.check_change_limit(keys, limit, force)
    old_facts = base.table("facts")
    wanted = () if rules is None else COMPANY_TABLES[:3] if std_rules is None else COMPANY_TABLES
    full = old_facts is not None and (not all(map(base.has, wanted)) or (std_rules is not None and _statements_lost(base)))
    if n == 0 and not full:
        return 0
    changed = files.join(keys, "cik", "left_semi")
    facts = commit.stage("changed_facts", _facts_of(changed))          # parsed once
    commit.replace("files_seen", changed.select("cik", "h"), keys)
    if old_facts is not None:
        # Facts from filing metadata are not of these files: they stay.
        kept = base.table("facts", commit.touched(keys)).where(F.col("form") == "submissions").join(keys, "cik", "left_semi")
        facts = facts.unionByName(kept.select(*facts.columns))
    commit.replace("facts", facts, keys)
    _dictionaries(commit, facts)
    if rules is not None:
        tables = company_tables(commit.table("facts") if full else facts, rules, std_rules, "load_seq", commit.stage)
        for name, rows in tables.items():
            commit.overwrite(name, rows) if full else commit.replace(name, rows, keys)
        if std_rules is not None:
            commit.overwrite("std_presentation", presentation_of(commit.table("std_lines"), definitions), key=None)
    else:
        commit.replace("companies", fa.companies_from_facts(facts, "load_seq"), keys)
    commit.publish()
    return n


def _statements_lost(base: Store) -> bool:
    """Companies processed but nothing standardized: a build that died in between; all statements are built again."""
    done, std = base.table("processed_ciks"), base.table("standardized_statements")
    return done is not None and dl.needs_full_rebuild(done.limit(1).count(), 0 if std is None else std.limit(1).count())


def _landed(spark: SparkSession, facts_dir: str, ciks: DataFrame | None) -> DataFrame:
    files = filings.company_facts_files(spark, facts_dir, ciks)
    return files.select("cik", "payload", F.col("sha256").alias("h"), F.col("mtime").cast("long").alias("load_seq"))


def build_facts(spark: SparkSession, facts_dir: str, store: str, rules: DataFrame, ciks: DataFrame | None = None, std_rules: DataFrame | None = None,
                definitions: DataFrame | None = None, buckets: int = BUCKETS) -> dict:
    """Full build: every table of the company files anew, as the store's next version.

    Companies without any fact get no row (full and delta builds share this rule).
    """
    commit = Store(spark, store, buckets).begin()
    files = _landed(spark, facts_dir, ciks)
    facts = commit.stage("all_facts", _facts_of(files))
    commit.overwrite("files_seen", files.select("cik", "h"))
    commit.overwrite("facts", facts)
    _dictionaries(commit, facts)
    for name, rows in company_tables(commit.table("facts"), rules, std_rules, "load_seq", commit.stage).items():
        commit.overwrite(name, rows)
    if std_rules is not None:
        commit.overwrite("std_presentation", presentation_of(commit.table("std_lines"), definitions), key=None)
    done = commit.publish()
    return {"facts": done.table("facts"), "companies": done.table("companies"), "version": done.version}


def update_facts(spark: SparkSession, facts_dir: str, store: str, rules: DataFrame, version: int | None = None, force: bool = False,
                 ciks: DataFrame | None = None, std_rules: DataFrame | None = None, definitions: DataFrame | None = None,
                 complete: bool = False, limit: int | None = None) -> int:
    """Delta build (``apply_company_files``): new or changed companies are exploded and replaced, as one new version.

    ``ciks`` limits it to some companies, such as ``changed_submissions``: the rest keep what is stored. ``complete``
    also removes companies whose file is gone.
    """
    if complete and ciks is not None:
        raise ValueError("files of some companies only are not complete")
    return apply_company_files(Store(spark, store), _landed(spark, facts_dir, ciks), rules, std_rules, definitions, complete, version, limit, force)


def build_submissions(spark: SparkSession, sub_dir: str, store: str, version: int | None = None) -> int:
    """Filing metadata: changed companies (canonical hash) get their payload row and
    their ``dei`` facts replaced; other namespaces of those companies stay."""
    base = Store(spark, store)
    commit = base.begin(version)
    subs = filings.submissions(spark, sub_dir)
    old = base.table("submissions")
    known = old.select("cik", "h") if old is not None else spark.createDataFrame([], "cik string, h string")
    keys = commit.stage("changed", dl.changed_keys(dl.classify_changes(subs.select("cik", "h"), known)))
    n = keys.count()
    if n == 0:
        return 0
    changed = commit.stage("changed_rows", subs.join(keys, "cik", "left_semi"))
    commit.replace("submissions", changed.select("cik", "h", "payload", "mtime"), keys)
    dei, facts = fa.dei_facts(changed), base.table("facts")
    if facts is None:
        facts = _facts_of(spark.createDataFrame([], "cik string, payload string, load_seq bigint"))
    dei = dei.select(*[c if c in dei.columns else F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in facts.columns])
    commit.replace("facts", dei, keys.select("cik", F.lit("dei").alias("namespace")), key=["cik", "namespace"])
    commit.overwrite("changed_submissions", keys)
    commit.publish()
    return n


def changed_submissions(spark: SparkSession, store: str, version: int) -> DataFrame:
    """Companies whose filing metadata changed in the given version, for ``update_facts``."""
    now, before = Store(spark, store, version=version), Store(spark, store, version=version - 1) if version > 1 else None
    entry = now.state["tables"].get("changed_submissions")
    if entry is None or (before is not None and before.state["tables"].get("changed_submissions") == entry):
        return spark.createDataFrame([], "cik string")
    return now.table("changed_submissions")


def rebuild_fx(spark: SparkSession, xml_path: str, store: str, as_of=None) -> DataFrame:
    """FX table: reference cubes -> USD rates within the lookback; an empty download
    keeps the previous table."""
    new = fx.triangulate_to_usd(filings.fx_cubes(spark, xml_path), as_of=as_of)
    old = latest_table(spark, store, "exchange_rates")
    if old is not None and new.limit(1).count() == 0:
        return old
    commit = Store(spark, store).begin()
    commit.overwrite("exchange_rates", new, key=None)
    return commit.publish().table("exchange_rates")


def rebuild_classification(spark: SparkSession, sic_facts: DataFrame, primary_tickers: DataFrame, rules: DataFrame,
                           overrides: DataFrame, store: str) -> DataFrame:
    commit = Store(spark, store).begin()
    commit.overwrite("cik_gics", cl.classify(sic_facts, primary_tickers, rules, overrides))
    return commit.publish().table("cik_gics")


def refresh_symbols(spark: SparkSession, tickers_json: str, funds_json: str, names_txt: str, store: str) -> None:
    """Ticker, fund and entity lists replace the rows of the companies they mention;
    rows of companies absent from a new list stay (replace-by-key)."""
    commit = Store(spark, store).begin()
    for name, new in (("tickers", filings.ticker_list(spark, tickers_json)),
                      ("funds", filings.fund_list(spark, funds_json)),
                      ("entities", filings.entity_names(spark, names_txt))):
        new = new.where(F.col("cik").isNotNull())
        commit.replace(name, new, new.select("cik").distinct())
    commit.publish()


def multi_cik_overrides(spark: SparkSession, json_path: str) -> DataFrame:
    """``{ticker: [cik, ...]}`` -> (ticker, cik, priority); list order is the priority."""
    t = spark.read.option("wholetext", "true").text(json_path)
    m = t.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("ticker", "ciks"))
    x = m.select(normalize_ticker("ticker").alias("ticker"), F.posexplode("ciks").alias("priority", "cik"))
    return x.select("ticker", normalize_cik("cik").alias("cik"), F.col("priority").cast("int").alias("priority"))


# The statement views a user can ask for, (period, transform) -> (rows, growth offset).
VIEW_MATRIX = {
    ("FY", "None"): ("annual", None), ("Q", "None"): ("quarterly", None), ("TTM", "None"): ("ttm", None),
    ("FY", "% YoY"): ("annual", 1), ("FY", "% PoP"): ("annual", 1),
    ("Q", "% YoY"): ("quarterly", 4), ("Q", "% PoP"): ("quarterly", 1),
    ("TTM", "% YoY"): ("ttm", 4), ("TTM", "% PoP"): ("ttm", 1),
}


def statement_view(std: DataFrame, rates: DataFrame | None, statement: str, period: str = "FY",
                   transform: str = "None", limit: int = 10, to_usd: bool = True) -> DataFrame:
    """Rows or growth of one statement for every company: period x transform, newest
    ``limit`` periods per company (0 = all), optionally converted to USD."""
    key = (period.upper() if period.upper() != "TTM" else "TTM", transform)
    if key not in VIEW_MATRIX:
        raise ValueError(f"unsupported view {period!r} / {transform!r}")
    rows_kind, offset = VIEW_MATRIX[key]
    s = std.where(F.col("statement") == statement)
    s = ttm(s) if rows_kind == "ttm" else s.where(F.col("frequency") == rows_kind)
    if offset is None and to_usd and rates is not None:
        s = st.to_usd(s, rates)
    if offset is not None:
        s = st.growth(s, offset)
    from finfacts.operators.latest import first_n_periods
    return first_n_periods(s, "cik", "period_ending", limit, newest_first=True, name="period_rank")


def export_store(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str, bucketed: set[str],
                 data_version: str, buckets: int = ex.BUCKETS) -> str:
    """Export tables as Parquet + manifest: tables in ``bucketed`` are written by cik
    bucket, the rest as one zstd file each; files are hashed on the executors; written
    row counts must equal the source counts (a mismatch raises). Returns the manifest
    JSON, also written under ``<out_dir>/_manifest``."""
    out_dir = out_dir.rstrip("/")
    source_counts, files, written = [], None, None
    for name, df in tables.items():
        path = f"{out_dir}/{name}"
        if name in bucketed:
            ex.write_bucketed(df, path, buckets=buckets)
        else:
            ex.write_small(df, path)
        source_counts.append((name, df.count()))
        f = ex.file_manifest(spark, path, name)
        c = ex.row_counts(spark, path, name)
        files = f if files is None else files.unionByName(f)
        written = c if written is None else written.unionByName(c)
    src = spark.createDataFrame(source_counts, "table string, rows long")
    bad = ex.reconcile(src, written).collect()   # one row per table at most
    if bad:
        raise RuntimeError(f"row counts differ after export: {[tuple(r) for r in bad]}")
    manifest = ex.manifest_json(files, written, data_version)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/_manifest")
    return manifest
