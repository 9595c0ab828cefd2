"""Ingest queries over the company-facts fixture: explode, documents, dictionaries,
processed companies, FX triangulation (L1-L5, L8, M1, I4, I12-I14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from finfacts.operators import dictionaries as dc
from finfacts.operators import facts as fa
from finfacts.operators import fx
from finfacts.operators.joins import literal_table
from finfacts.plans.fixtures import AS_OF
from finfacts.plans.registry import query, sql
from finfacts.sources import filings

# Fixture rules table (statement, tag): which statement each fixture fact tag
# belongs to, standing in for the statement schema's tag sets.
FIXTURE_STATEMENT_RULES = [
    ("balance_sheet", "view"), ("balance_sheet", "signup"),
    ("income_statement", "purchase"), ("income_statement", "click"),
    ("cash_flow", "error"),
]


def statement_rules(spark):
    return literal_table(spark, FIXTURE_STATEMENT_RULES, "statement string, tag string")


def facts(c):
    """The exploded facts table (derived once from fx_doc; stored when materialised)."""
    return c["facts"]


def _norm_cik(x):
    d = f"coalesce(nullif(ltrim(trim({x}), '0'), ''), '0')"
    return (f"CASE WHEN trim({x}) <> '' AND regexp_matches({d}, '^[0-9]+$') "
            f"THEN CASE WHEN length({d}) >= 10 THEN {d} ELSE lpad({d}, 10, '0') END END")


def _date(x):
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({x} AS DATE) END"


EXPLODE_CTES = [
    ("d0", "SELECT event_id, CAST(payload AS JSON) AS j FROM fx_doc"),
    ("d1", "SELECT event_id, j, json_extract(j, '$.facts') AS fj, unnest(json_keys(json_extract(j, '$.facts'))) AS namespace FROM d0"),
    ("d2", """SELECT event_id, j, namespace, json_extract(fj, '$."' || namespace || '"') AS nj,
                     unnest(json_keys(json_extract(fj, '$."' || namespace || '"'))) AS tag FROM d1"""),
    ("d3", """SELECT event_id, j, namespace, tag, json_extract(nj, '$."' || tag || '"') AS tj FROM d2"""),
    ("d4", """SELECT event_id, j, namespace, tag, tj, json_extract(tj, '$.units') AS uj,
                     unnest(json_keys(json_extract(tj, '$.units'))) AS unit FROM d3"""),
    ("d5", """SELECT event_id, j, namespace, tag, tj, unit,
                     unnest(json_extract(json_extract(uj, '$."' || unit || '"'), '$[*]')) AS p FROM d4"""),
    ("facts", f"""
SELECT event_id, {_norm_cik("json_extract_string(j, '$.cik')")} AS cik,
       coalesce(json_extract_string(j, '$.entityName'), '') AS entity_name, namespace, tag,
       coalesce(json_extract_string(tj, '$.label'), '') AS label,
       coalesce(json_extract_string(tj, '$.description'), '') AS description, unit,
       {_date("json_extract_string(p, '$.start')")} AS "start", {_date("json_extract_string(p, '$.end')")} AS "end",
       TRY_CAST(trim(json_extract_string(p, '$.val')) AS DOUBLE) AS val, CAST(NULL AS VARCHAR) AS val_text,
       json_extract_string(p, '$.accn') AS accn,
       CASE WHEN regexp_matches(trim(json_extract_string(p, '$.fy')), '^[+-]?[0-9]+$')
            THEN TRY_CAST(trim(json_extract_string(p, '$.fy')) AS INTEGER) END AS fy,
       json_extract_string(p, '$.fp') AS fp, json_extract_string(p, '$.form') AS form,
       {_date("json_extract_string(p, '$.filed')")} AS filed, json_extract_string(p, '$.frame') AS frame
FROM d5 WHERE json_type(p) = 'OBJECT'"""),
]

_FACT_COLS = ("event_id, cik, entity_name, namespace, tag, label, description, unit, \"start\", \"end\", val, val_text, "
              "accn, fy, fp, form, filed, frame")


@query("facts_explode", "L1 A1 I1 I3 I4", sql(["fx_doc"], EXPLODE_CTES, f"SELECT {_FACT_COLS} FROM facts"))
def facts_explode(c):
    return fa.explode_company_facts(c["fx_doc"], "payload", doc_id="event_id")


# One fragment per company line item; its parts are put together as text, nulls first as in the operator's order.
_DOC_CTES = EXPLODE_CTES + [
    ("records", """
SELECT cik, namespace, tag, unit, label, description, "end", filed, accn, "start", val, fy, fp, form, frame,
       concat('{"end":', coalesce('"' || strftime("end", '%Y-%m-%d') || '"', 'null'), ',"val":', coalesce(CAST(val AS VARCHAR), 'null'),
              ',"accn":', coalesce('"' || accn || '"', 'null'), ',"fy":', coalesce(CAST(fy AS VARCHAR), 'null'),
              ',"fp":', coalesce('"' || fp || '"', 'null'), ',"form":', coalesce('"' || form || '"', 'null'),
              ',"filed":', coalesce('"' || strftime(filed, '%Y-%m-%d') || '"', 'null'),
              coalesce(',"start":"' || strftime("start", '%Y-%m-%d') || '"', ''),
              CASE WHEN frame <> '' THEN ',"frame":"' || frame || '"' ELSE '' END, '}') AS record FROM facts"""),
    ("units", """
SELECT cik, namespace, tag, unit, max(label) AS label, max(description) AS description,
       '"' || unit || '":[' || string_agg(record, ',' ORDER BY "end" NULLS FIRST, filed NULLS FIRST, accn NULLS FIRST, "start" NULLS FIRST,
                                          val NULLS FIRST, fy NULLS FIRST, fp NULLS FIRST, form NULLS FIRST, frame NULLS FIRST) || ']' AS records
FROM records GROUP BY cik, namespace, tag, unit"""),
    ("names", "SELECT cik, arg_max(entity_name, event_id) AS entity_name FROM facts GROUP BY cik"),
]


@query("facts_document", "M1 E12 G4 (document parts per line item)", sql(["fx_doc"], _DOC_CTES, """
SELECT cik, entity_name, namespace, tag, '{"label":"' || max(label) || '","description":"' || max(description) || '","units":{'
       || string_agg(records, ',' ORDER BY unit) || '}}' AS fragment
FROM units JOIN names USING (cik) GROUP BY cik, entity_name, namespace, tag"""))
def facts_document(c):
    f = facts(c)
    return fa.company_document_parts(f, fa.companies_from_facts(f, "event_id"))


@query("facts_document_text", "M1 E12 G4 (whole documents in pieces, also tags without facts)", sql(["fx_doc"], _DOC_CTES + [
    ("kept", "SELECT * FROM units WHERE CAST(cik AS BIGINT) % 5 <> 2 OR tag <> 'click'"),
    ("parts", """
SELECT cik, namespace, tag, '{"label":"' || max(u.label) || '","description":"' || max(u.description) || '","units":{'
       || coalesce(string_agg(k.records, ',' ORDER BY k.unit), '') || '}}' AS fragment
FROM units u LEFT JOIN kept k USING (cik, namespace, tag, unit) GROUP BY cik, namespace, tag"""),
    ("numbered", """
SELECT *, row_number() OVER c AS i, count(*) OVER (PARTITION BY cik) AS n, lag(namespace) OVER c AS before, lead(namespace) OVER c AS after
FROM parts JOIN names USING (cik) WINDOW c AS (PARTITION BY cik ORDER BY namespace, tag)"""),
], """
SELECT cik, namespace, tag, if(i = 1, '{"cik":"' || cik || '","entityName":"' || entity_name || '","facts":{', '')
       || if(before IS DISTINCT FROM namespace, '"' || namespace || '":{', '') || '"' || tag || '":' || fragment
       || if(after IS DISTINCT FROM namespace, '}', '') || if(i = n, '}}', ',') AS text
FROM numbered"""))
def facts_document_text(c):
    f = facts(c)
    some = f.where((F.col("cik").cast("long") % 5 != 2) | (F.col("tag") != "click"))      # tags of some companies have no facts
    return fa.document_text(fa.company_document_parts(some, fa.companies_from_facts(f, "event_id"), f))


@query("companies_from_facts", "L1 (company rows; no facts -> no company)", sql(["fx_doc"], EXPLODE_CTES, """
SELECT cik, arg_max(entity_name, event_id) AS entity_name FROM facts GROUP BY cik"""))
def companies_from_facts(c):
    return fa.companies_from_facts(facts(c), "event_id")


@query("tag_dictionary", "L2 L3 (first-seen label)", sql(["fx_doc"], EXPLODE_CTES, """
SELECT namespace, tag, arg_min(label, event_id) AS label, arg_min(description, event_id) AS description,
       count(DISTINCT cik) AS companies
FROM facts GROUP BY namespace, tag"""))
def tag_dictionary(c):
    return fa.tag_metadata(facts(c), "event_id")


@query("dict_encode_roundtrip", "L3 L8 D1 D2 (decode(encode(x)) = x over stored dictionaries)",
       sql(["fx_doc"], EXPLODE_CTES, f"SELECT {_FACT_COLS} FROM facts"))
def dict_encode_roundtrip(c):
    f, tags, accns = facts(c), c["xbrl_tags"], c["accessions"]
    enc = dc.encode_key(dc.encode_key(f, tags, ["namespace", "tag"], "tag_id"), accns, ["accn"], "accn_id")
    back = dc.decode_key(dc.decode_key(enc, tags, ["namespace", "tag"], "tag_id"), accns, ["accn"], "accn_id", spread=["event_id"])
    return back.select(*f.columns)


@query("dictionary_delta", "L2 L3 (dictionary grown by a later load; texts first seen stay)", sql(["fx_doc"], EXPLODE_CTES + [
    ("loads", "SELECT *, if(event_id % 3 = 1 AND accn < '0001-24-3', 1, 2) AS load FROM facts WHERE accn IS NOT NULL"),
    ("first_load", "SELECT tag, accn, min(load) AS load FROM loads GROUP BY ALL")], """
SELECT tag, accn, arg_min(label, event_id) AS label, load AS found_in FROM loads JOIN first_load USING (tag, accn, load) GROUP BY ALL"""))
def dictionary_delta(c):
    f = facts(c).where("accn is not null").withColumn("found_in", F.when((F.col("event_id") % 3 == 1) & (F.col("accn") < "0001-24-3"), 1).otherwise(2))
    stored = dc.dictionary_delta(None, f.where("found_in = 1"), ["tag", "accn"], ["label", "found_in"], "event_id")
    return dc.dictionary_delta(stored, f.where("found_in = 2"), ["tag", "accn"], ["label", "found_in"], "event_id").select("tag", "accn", "label", "found_in")


@query("schema_tag_rules", "A11 (schemas of any depth)", sql(["fx_schema"], [
    ("node", "SELECT s.statement, t.value AS list FROM fx_schema s, json_tree(s.json) t WHERE t.key = 'xbrl_tags' AND t.type = 'ARRAY'"),
    ("item", "SELECT statement, unnest(json_extract(list, '$[*]')) AS x FROM node")], """
SELECT DISTINCT statement, x->>'$.namespace' AS namespace, x->>'$.tag' AS tag FROM item
WHERE json_type(x) = 'OBJECT' AND x->>'$.namespace' IN ('us-gaap', 'ifrs-full') AND json_type(x, '$.tag') = 'VARCHAR'"""))
def schema_tag_rules(c):
    return filings.statement_tag_rules(c["fx_schema"].select("statement", "json"))


@query("decode_views", "L8 D1 D2 D3 (decoded facts + tag metadata views over encoded tables)",
       sql(["fx_doc"], EXPLODE_CTES + [("tag_meta", """
SELECT namespace, tag, arg_min(label, event_id) AS first_label FROM facts GROUP BY namespace, tag""")], """
SELECT f.cik, f.namespace, f.tag, m.first_label AS tag_label, f.unit, f."end", f.val, f.accn, f.fy, f.fp, f.form, f.filed
FROM facts f JOIN tag_meta m ON m.namespace = f.namespace AND m.tag = f.tag"""))
def decode_views(c):
    f = facts(c)
    enc, tags, accns = fa.encode(f)
    meta = fa.tag_metadata(f, "event_id").select("namespace", "tag", F.col("label").alias("tag_label"))
    tag_dim = tags.join(meta, ["namespace", "tag"], "inner")   # xbrl_tags with the first-seen label
    view = fa.decode(enc, tag_dim, accns)
    return view.select("cik", "namespace", "tag", "tag_label", "unit", "end", "val", "accn", "fy", "fp", "form", "filed")


def _rules_sql():
    body = ", ".join(f"('{s}', '{t}')" for s, t in FIXTURE_STATEMENT_RULES)
    return f"SELECT * FROM (VALUES {body}) AS t(statement, tag)"


_PROCESSED_CTES = EXPLODE_CTES + [("rules", _rules_sql()), ("processed", """
SELECT cik, max(statement = 'balance_sheet') AS has_balance, max(statement = 'income_statement') AS has_income,
       max(statement = 'cash_flow') AS has_cash_flow
FROM (SELECT DISTINCT cik, tag FROM facts WHERE namespace IN ('us-gaap', 'ifrs-full')) ct
JOIN rules USING (tag) GROUP BY cik
HAVING max(statement = 'balance_sheet') AND max(statement = 'income_statement') AND max(statement = 'cash_flow')""")]


def processed(c):
    """The stored processed-companies table (built once per store)."""
    return c["processed_ciks"]


@query("processed_companies", "L5 E4 C9 A11 D10", sql(["fx_doc"], _PROCESSED_CTES,
                                                     "SELECT cik, has_balance, has_income, has_cash_flow FROM processed"))
def processed_companies(c):
    return fa.processed_companies(facts(c), statement_rules(c.spark))


@query("processed_counts", "E10 K6", sql(["fx_doc"], _PROCESSED_CTES, """
SELECT count(*) AS total, CAST(sum(CAST(has_balance AS INTEGER)) AS BIGINT) AS with_balance,
       CAST(sum(CAST(has_income AS INTEGER)) AS BIGINT) AS with_income,
       CAST(sum(CAST(has_cash_flow AS INTEGER)) AS BIGINT) AS with_cash_flow
FROM processed"""))
def processed_counts(c):
    return fa.processed_counts(processed(c))


# EUR-based daily cubes derived from the USD-based fixture rates: a cube quotes each
# currency per EUR and includes USD itself (units of USD per EUR).
_CUBES_SQL = """
SELECT rate_date, 'USD' AS currency, rate FROM fx_rates WHERE from_currency = 'EUR' AND to_currency = 'USD'
UNION ALL
SELECT x.rate_date, x.from_currency AS currency, e.rate / x.rate AS rate
FROM fx_rates x JOIN fx_rates e ON e.rate_date = x.rate_date AND e.from_currency = 'EUR' AND e.to_currency = 'USD'
WHERE x.from_currency NOT IN ('EUR', 'USD') AND x.to_currency = 'USD'"""


def cubes(c):
    r = c["fx_rates"].where(F.col("to_currency") == "USD")
    day = r.groupBy("rate_date").agg(
        F.max(F.when(F.col("from_currency") == "EUR", F.col("rate"))).alias("_e"),
        F.collect_list(F.when(~F.col("from_currency").isin("EUR", "USD"), F.struct("from_currency", "rate"))).alias("_o"))
    others = F.transform("_o", lambda q: F.struct(q["from_currency"].alias("currency"), (F.col("_e") / q["rate"]).alias("rate")))
    usd = F.array(F.struct(F.lit("USD").alias("currency"), F.col("_e").alias("rate")))
    return (day.where(F.col("_e").isNotNull()).select("rate_date", F.explode(F.concat(usd, others)).alias("_q"))
            .select("rate_date", "_q.currency", "_q.rate"))


# Fixture orders begin in 1995: a lookback of five years leaves some of their rates out.
LOOKBACK = 1825


@query("fx_triangulate", "I14 C12 A6 L10", sql(["fx_rates"], [("cubes", _CUBES_SQL), ("u", """
SELECT rate_date, max(CASE WHEN currency = 'USD' THEN rate END) AS usd FROM cubes GROUP BY rate_date
HAVING max(CASE WHEN currency = 'USD' THEN rate END) IS NOT NULL""")], f"""
SELECT rate_date, 'USD' AS from_currency, 'USD' AS to_currency, 1.0::DOUBLE AS rate FROM u
WHERE rate_date >= DATE '{AS_OF}' - INTERVAL {LOOKBACK} DAY
UNION ALL SELECT rate_date, 'EUR', 'USD', usd FROM u WHERE rate_date >= DATE '{AS_OF}' - INTERVAL {LOOKBACK} DAY
UNION ALL SELECT c.rate_date, c.currency, 'USD', u.usd / NULLIF(c.rate, 0.0) FROM cubes c JOIN u USING (rate_date)
WHERE c.currency <> 'USD' AND c.rate_date >= DATE '{AS_OF}' - INTERVAL {LOOKBACK} DAY"""))
def fx_triangulate(c):
    return fx.triangulate_to_usd(cubes(c), as_of=AS_OF, lookback_days=LOOKBACK)
