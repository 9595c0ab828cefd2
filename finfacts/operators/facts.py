"""Company-facts ingest: nested JSON -> fact rows, tag metadata, dictionary ids,
processed-company flags, DEI facts from filing metadata, per-company documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.functions.ids import normalize_cik, strict_date, to_double_or_null, to_int_or_null

PERIOD_SCHEMA = ("struct<start:string,end:string,val:string,accn:string,fy:string,fp:string,form:string,"
                 "filed:string,frame:string>")
STATEMENT_NAMESPACES = ("us-gaap", "ifrs-full")


TAG_SCHEMA = f"struct<label:string,description:string,units:map<string,array<{PERIOD_SCHEMA}>>>"
DOC_SCHEMA = f"struct<cik:string,entityName:string,facts:map<string,map<string,{TAG_SCHEMA}>>>"


def _facts_by_level(payload):
    """The ``facts`` map parsed one nesting level at a time; malformed entries at any
    level (a tag that is not an object, a period that is a number, ...) are dropped."""
    top = F.from_json(payload, "struct<facts:map<string,string>>")["facts"]

    def periods(s):
        objects = F.filter(F.from_json(s, "array<string>"), lambda x: F.ltrim(x).startswith("{"))
        parsed = F.transform(objects, lambda x: F.from_json(x, PERIOD_SCHEMA))
        return F.filter(parsed, lambda r: r.isNotNull())

    def tag(s):
        s = F.when(F.ltrim(s).startswith("{"), s)
        t = F.from_json(s, "struct<label:string,description:string,units:map<string,string>>")
        units = F.map_filter(F.transform_values(t["units"], lambda _u, v: periods(v)), lambda _u, v: v.isNotNull())
        return F.when(t.isNotNull(), F.struct(t["label"].alias("label"), t["description"].alias("description"),
                                              units.alias("units")))

    def namespace(s):
        s = F.when(F.ltrim(s).startswith("{"), s)
        tags = F.transform_values(F.from_json(s, "map<string,string>"), lambda _t, v: tag(v))
        return F.map_filter(tags, lambda _t, v: v.isNotNull())

    return F.map_filter(F.transform_values(top, lambda _n, v: namespace(v)), lambda _n, v: v.isNotNull())


def explode_company_facts(docs: DataFrame, payload: str = "payload", doc_id: str | None = None) -> DataFrame:
    """namespace x tag x unit x period -> one row per fact.

    Every JSON scalar is read as text and coerced like Python's ``float()`` /
    ``int()`` (``"2024"`` -> 2024, ``"bad"`` -> null). A document is parsed once
    with the full typed schema; only when that fails (a malformed nested level
    nulls the whole map) is it re-parsed level by level *in the same projection*,
    so a bad namespace, tag, unit list or period is skipped without losing the rest
    of the document. ``val_text`` is always null here.
    """
    keep = [doc_id] if doc_id else []
    typed = F.from_json(F.col(payload), DOC_SCHEMA)
    d = docs.select(*keep, F.col(payload), typed.alias("_d"))
    facts = F.when(F.col("_d.facts").isNotNull(), F.col("_d.facts")).otherwise(_facts_by_level(F.col(payload)))
    ns = d.select(*keep, normalize_cik(F.col("_d.cik")).alias("cik"),
                  F.coalesce(F.col("_d.entityName"), F.lit("")).alias("entity_name"),
                  F.explode(facts).alias("namespace", "_ns"))
    tags = ns.select(*keep, "cik", "entity_name", "namespace", F.explode("_ns").alias("tag", "_t"))
    units = tags.select(*keep, "cik", "entity_name", "namespace", "tag",
                        F.coalesce(F.col("_t.label"), F.lit("")).alias("label"),
                        F.coalesce(F.col("_t.description"), F.lit("")).alias("description"),
                        F.explode(F.col("_t.units")).alias("unit", "_u"))
    p = units.select(*keep, "cik", "entity_name", "namespace", "tag", "label", "description", "unit",
                     F.explode("_u").alias("_r")).where(F.col("_r").isNotNull())
    return p.select(*keep, "cik", "entity_name", "namespace", "tag", "label", "description", "unit",
                    strict_date(F.col("_r.start")).alias("start"), strict_date(F.col("_r.end")).alias("end"),
                    to_double_or_null(F.col("_r.val")).alias("val"), F.lit(None).cast("string").alias("val_text"),
                    F.col("_r.accn").alias("accn"), to_int_or_null(F.col("_r.fy")).alias("fy"),
                    F.col("_r.fp").alias("fp"), F.col("_r.form").alias("form"),
                    strict_date(F.col("_r.filed")).alias("filed"), F.col("_r.frame").alias("frame"))


def companies_from_facts(facts: DataFrame, load_order: str) -> DataFrame:
    """(cik, entity_name) of companies with at least one fact; the name of the latest load wins."""
    return facts.groupBy("cik").agg(F.max_by("entity_name", load_order).alias("entity_name"))


def tag_metadata(facts: DataFrame, load_order: str) -> DataFrame:
    """Global tag dimension: (namespace, tag, label, description, companies); the label
    and description first seen (smallest ``load_order``) are kept."""
    return (facts.groupBy("namespace", "tag")
                 .agg(F.min_by("label", load_order).alias("label"),
                      F.min_by("description", load_order).alias("description"),
                      F.countDistinct("cik").alias("companies")))


def dictionary(df: DataFrame, cols: Sequence[str], id_name: str) -> DataFrame:
    """Dictionary dimension ``(id, *cols)`` with ids from a 64-bit hash of the key.

    Hash ids need no global sort or sequence and are stable across loads and
    delta batches; ``assert_unique_ids`` checks the dimension for collisions.
    """
    cols = list(cols)
    return df.select(*cols).distinct().select(F.xxhash64(*cols).alias(id_name), *cols)


def assert_unique_ids(dim: DataFrame, id_name: str) -> None:
    dup = dim.groupBy(id_name).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"hash collision in dictionary {id_name}")


def encode(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """facts -> (facts_enc, xbrl_tags, accessions). Ids are computed in place from
    the key hash, so encoding is a projection, not a join."""
    tags = dictionary(facts, ["namespace", "tag"], "tag_id")
    accns = dictionary(facts.where(F.col("accn").isNotNull()), ["accn"], "accn_id")
    enc = facts.select(*[c for c in facts.columns if c not in ("namespace", "tag", "accn")],
                       F.xxhash64("namespace", "tag").alias("tag_id"),
                       F.when(F.col("accn").isNotNull(), F.xxhash64("accn")).alias("accn_id"))
    return enc, tags, accns


def decode(facts_enc: DataFrame, tags: DataFrame, accns: DataFrame) -> DataFrame:
    """The ``facts`` view: inner join to the tag dimension, left join to accessions.

    Facts without an accession (all ``dei`` facts) match nothing; a second join key, which for other facts repeats
    the id, spreads them over all tasks.
    """
    f = facts_enc.withColumn("_spread", F.coalesce("accn_id", F.xxhash64("cik", "tag_id", "end")))
    a = accns.withColumn("_spread", F.col("accn_id"))
    out = f.join(tags, "tag_id", "inner").join(a, ["accn_id", "_spread"], "left")
    return out.drop("tag_id", "accn_id", "_spread")


def processed_companies(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Companies that report at least one tag of each statement (balance, income, cash flow).

    rules: (statement, tag) — which statement a us-gaap / ifrs-full tag belongs to.
    """
    ct = facts.where(F.col("namespace").isin(*STATEMENT_NAMESPACES)).select("cik", "tag").distinct()
    j = ct.join(rules.select("statement", "tag").distinct(), "tag", "inner")
    flags = j.groupBy("cik").agg(
        F.max(F.col("statement") == "balance_sheet").alias("has_balance"),
        F.max(F.col("statement") == "income_statement").alias("has_income"),
        F.max(F.col("statement") == "cash_flow").alias("has_cash_flow"))
    return flags.where(F.col("has_balance") & F.col("has_income") & F.col("has_cash_flow"))


def processed_counts(processed: DataFrame) -> DataFrame:
    """One-row summary (total, with_balance, with_income, with_cash_flow)."""
    return processed.agg(F.count(F.lit(1)).alias("total"),
                         F.sum(F.col("has_balance").cast("int")).alias("with_balance"),
                         F.sum(F.col("has_income").cast("int")).alias("with_income"),
                         F.sum(F.col("has_cash_flow").cast("int")).alias("with_cash_flow"))


# DEI attributes taken from a company's filing metadata
# (tag, metadata key, description); the first is numeric (unit "pure"), the rest text.
DEI_NUMERIC = [("EntitySicCode", "sic", "Standard Industrial Classification (SIC) Code")]
DEI_TEXT = [
    ("EntityType", "entityType", "Entity Type"),
    ("EntityFilerCategory", "category", "Entity Filer Category"),
    ("EntitySicDescription", "sicDescription", "SIC Industry Description"),
    ("EntityFiscalYearEnd", "fiscalYearEnd", "Fiscal Year End (MMDD)"),
    ("EntityStateOfIncorporation", "stateOfIncorporation", "State of Incorporation"),
    ("EntityName", "name", "Registrant Name"),
    ("EntityEin", "ein", "Employer Identification Number"),
    ("EntityLei", "lei", "Legal Entity Identifier"),
]


def dei_facts(submissions: DataFrame) -> DataFrame:
    """Filing metadata (cik, meta map<string,string>, mtime timestamp) -> DEI fact rows.

    end = filed = file date, form ``submissions``; empty attributes are skipped,
    a numeric attribute that does not parse is skipped.
    """
    day = F.to_date("mtime")
    entries = [F.struct(F.lit(t).alias("tag"), F.lit(k).alias("key"), F.lit(d).alias("description"),
                        F.lit(num).alias("numeric"))
               for num, rows in ((True, DEI_NUMERIC), (False, DEI_TEXT)) for t, k, d in rows]
    x = submissions.select("cik", day.alias("_day"), "meta", F.explode(F.array(*entries)).alias("_a"))
    raw = F.element_at(F.col("meta"), F.col("_a.key"))
    num = to_double_or_null(raw)
    x = x.where(raw.isNotNull() & (raw != "")).where(~F.col("_a.numeric") | num.isNotNull())
    return x.select("cik", F.lit("dei").alias("namespace"), F.col("_a.tag").alias("tag"),
                    F.when(F.col("_a.numeric"), F.lit("pure")).otherwise(F.lit("string")).alias("unit"),
                    F.lit(None).cast("date").alias("start"), F.col("_day").alias("end"),
                    F.when(F.col("_a.numeric"), num).alias("val"),
                    F.when(~F.col("_a.numeric"), raw).alias("val_text"),
                    F.lit(None).cast("string").alias("accn"), F.lit(None).cast("int").alias("fy"),
                    F.lit(None).cast("string").alias("fp"), F.lit("submissions").alias("form"),
                    F.col("_day").alias("filed"), F.lit(None).cast("string").alias("frame"),
                    F.col("_a.tag").alias("label"), F.col("_a.description").alias("description"))


def _cmp(a, b):
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def _sorted_by(arr, *fields):
    """array_sort with a comparator on the named fields (nulls first); the elements
    carry maps, which Spark cannot order directly."""
    def comparator(x, y):
        out = F.lit(0)
        for f in reversed(fields):
            a = F.coalesce(x[f].cast("string"), F.lit(""))
            b = F.coalesce(y[f].cast("string"), F.lit(""))
            out = F.when(_cmp(a, b) != 0, _cmp(a, b)).otherwise(out)
        return out
    return F.array_sort(arr, comparator)


def _entry(key: str, value) -> "F.Column":
    return F.struct(F.lit(key).alias("key"), value.cast("variant").alias("value"))


def company_document_parts(facts: DataFrame, companies: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """The company-facts document as bounded parts, one row per (cik, namespace, tag):
    ``fragment`` is the JSON object stored at ``facts[namespace][tag]`` —
    ``{label, description, units: {unit: [records]}}`` with records sorted by (end, filed), ties by (accn, start,
    val, val_text, fy, fp, form, frame), nulls first.

    ``val_text`` is preferred over ``val``; null ``start`` and empty ``frame`` keys are
    omitted, other nulls are kept; values are VARIANT so text and numbers render
    natively. Every group is one line item of one company (bounded by its periods),
    so a company holding a third of all facts is still spread over many groups and
    tasks; ``document_text`` nests the fragments under ``{cik, entityName, facts}``. With ``tags`` (cik, namespace, tag,
    label, description), a company's tags without facts get a part with no units.
    """
    def record(r):
        text_ok = r["val_text"].isNotNull() & (r["val_text"] != "")
        val = F.when(text_ok, r["val_text"].cast("variant")).otherwise(r["val"].cast("variant"))
        entries = F.array(
            _entry("end", F.date_format(r["end"], "yyyy-MM-dd")), F.struct(F.lit("val").alias("key"), val.alias("value")),
            _entry("accn", r["accn"]), _entry("fy", r["fy"]), _entry("fp", r["fp"]),
            _entry("form", r["form"]), _entry("filed", F.date_format(r["filed"], "yyyy-MM-dd")),
            _entry("start", F.date_format(r["start"], "yyyy-MM-dd")),
            _entry("frame", F.when(r["frame"] != "", r["frame"])))
        return F.map_from_entries(F.filter(entries, lambda e: ~(e["key"].isin("start", "frame") & e["value"].isNull())))

    listed = tags
    order = F.struct("end", "filed", "accn", "start", "val", "val_text", "fy", "fp", "form", "frame")
    r = facts.select("cik", "namespace", "tag", "label", "description", "unit", order.alias("_o"))
    units = r.groupBy("cik", "namespace", "tag", "unit").agg(
        F.transform(F.array_sort(F.collect_list("_o")), record).alias("_recs"),
        F.max("label").alias("label"), F.max("description").alias("description"))
    tags = units.groupBy("cik", "namespace", "tag").agg(
        F.max("label").alias("label"), F.max("description").alias("description"),
        F.map_from_entries(_sorted_by(F.collect_list(F.struct("unit", "_recs")), "unit")).alias("units"))
    if listed is not None:
        bare = listed.groupBy("cik", "namespace", "tag").agg(F.max("label").alias("_label"), F.max("description").alias("_description"))
        tags = (tags.join(bare, ["cik", "namespace", "tag"], "full_outer").withColumn("label", F.coalesce("label", "_label"))
                .withColumn("description", F.coalesce("description", "_description"))
                .withColumn("units", F.coalesce("units", F.create_map().cast(tags.schema["units"].dataType))))
    names = companies.select("cik", F.coalesce(F.col("entity_name"), F.lit("")).alias("entity_name"))
    parts = tags.join(names, "cik", "inner")
    return parts.select("cik", "entity_name", "namespace", "tag",
                        F.to_json(F.struct("label", "description", "units")).alias("fragment"))


def _json_text(c):
    """A text as JSON: quoted and escaped."""
    return F.regexp_replace(F.to_json(F.array(c)).substr(F.lit(2), F.lit(1 << 30)), r"\]$", "")


def document_text(parts: DataFrame) -> DataFrame:
    """(cik, namespace, tag, text): pieces of whole documents ``{cik, entityName, facts}``; a company's pieces in the order
    of (namespace, tag) are its document.

    A part opens the brackets of its company and namespace if it is their first, and closes them if it is their last.
    First and last come from minima and maxima, aggregated before the shuffle, so no task holds a company.
    """
    edge = parts.groupBy("cik", "namespace").agg(F.min("tag").alias("_first"), F.max("tag").alias("_last"))
    ends = edge.groupBy("cik").agg(F.min("namespace").alias("_first_ns"), F.max("namespace").alias("_last_ns"))
    p = parts.join(edge.join(ends, "cik"), ["cik", "namespace"])
    opens, closes = F.col("tag") == F.col("_first"), F.col("tag") == F.col("_last")
    head = F.regexp_replace(F.to_json(F.struct(F.col("cik"), F.col("entity_name").alias("entityName"))), r"\}$", "")
    text = F.concat(
        F.when(opens & (F.col("namespace") == F.col("_first_ns")), F.concat(head, F.lit(',"facts":{'))).otherwise(""),
        F.when(opens, F.concat(_json_text(F.col("namespace")), F.lit(":{"))).otherwise(""),
        _json_text(F.col("tag")), F.lit(":"), F.col("fragment"),
        F.when(~closes, ",").when(F.col("namespace") != F.col("_last_ns"), "},").otherwise("}}}"))
    return p.select("cik", "namespace", "tag", text.alias("text"))


def assemble_documents(parts: DataFrame) -> DataFrame:
    """Whole documents, one row per company.

    For a small, pre-filtered set of companies (a lookup); a whole document is one
    group, so ``document_text`` serves every company of a full store.
    """
    return document_text(parts).groupBy("cik").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("namespace", "tag", "text"))),
                                                                            lambda x: x["text"]), "").alias("document"))
