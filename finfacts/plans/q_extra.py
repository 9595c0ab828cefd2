"""Standardization, presentation, registrant merge, TTM, company sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finfacts.operators.joins import literal_table
from finfacts.functions.payload import canonical_json_sha256
from finfacts.operators import incremental as inc
from finfacts.operators import periods, sets
from finfacts.operators import standardize as sd
from finfacts.operators import statements as st
from finfacts.plans import dims
from finfacts.plans.fixtures import AS_OF, RECENT_FROM
from finfacts.plans.q_company import _CANON_CTES
from finfacts.plans.q_ingest import EXPLODE_CTES, FIXTURE_STATEMENT_RULES, facts, statement_rules
from finfacts.plans.registry import query, sql

R = f"DATE '{RECENT_FROM}'"

# Fixture standardization rules (company_type, statement, line_item, priority, namespace, tag, kind).
FIXTURE_STD_RULES = [
    ("industrial", "balance_sheet", "total_assets", 1, "us-gaap", "view", "instant"),
    ("industrial", "balance_sheet", "total_assets", 2, "us-gaap", "signup", "instant"),
    ("industrial", "income_statement", "total_revenue", 1, "us-gaap", "purchase", "duration"),
    ("industrial", "income_statement", "total_revenue", 2, "us-gaap", "click", "duration"),
    ("industrial", "cash_flow", "net_cash_from_operating_activities", 1, "us-gaap", "error", "instant"),
]


_STD_CTES = [
    ("rules", dims.values_sql(FIXTURE_STD_RULES, ["company_type", "statement", "line_item", "priority", "namespace",
                                                  "tag", "kind"],
                              ["VARCHAR", "VARCHAR", "VARCHAR", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR"])),
    ("classed", """
SELECT f.cik, r.statement, r.line_item, r.priority, r.kind, f."start" AS s, f."end" AS e, upper(coalesce(f.fp, '')) AS fp, f.val, f.unit,
       r.company_type, f.namespace, f.tag, coalesce(f.filed, f."end") AS filed,
       CASE WHEN r.kind = 'duration' THEN list_filter([('quarterly', 80, 100), ('half', 165, 200), ('nine', 250, 290), ('annual', 350, 380)],
                                                      lambda c: f."end" - f."start" BETWEEN c[2] AND c[3])[1][1]
            WHEN f."start" IS NULL THEN if(upper(f.fp) = 'FY', 'annual', 'quarterly') END AS class
FROM facts f JOIN rules r ON r.company_type = 'industrial' AND r.namespace = f.namespace AND r.tag = f.tag
WHERE f.val IS NOT NULL AND f."end" IS NOT NULL"""),
    ("p", """
SELECT row_number() OVER () AS id, * FROM (SELECT * FROM classed WHERE class IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY cik, statement, line_item, e, class
                           ORDER BY priority ASC, filed DESC, val DESC, fp DESC, s DESC NULLS LAST, unit DESC, namespace DESC, tag DESC) = 1)"""),
    ("years", """
SELECT DISTINCT cik, s, if(class = 'annual', e, (s + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE) AS e, class = 'annual' AS whole FROM p
WHERE kind = 'duration' AND ((class = 'annual' AND fp IN ('FY', '')) OR (class, fp) IN (('half', 'Q2'), ('nine', 'Q3')))"""),
    ("held", """
SELECT p.id, y.s AS fs, y.e AS fe FROM p JOIN years y ON y.cik = p.cik AND y.s <= coalesce(p.s, p.e) + 7 AND p.e <= y.e + 7
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY y.whole DESC, y.e, y.s DESC) = 1"""),
    ("before", "SELECT p.id, max(y.e) AS le FROM p JOIN years y ON y.cik = p.cik AND y.whole AND y.e < p.e GROUP BY p.id"),
    ("placed", """
SELECT p.*, CASE WHEN h.fs IS NOT NULL THEN h.fs WHEN p.e - b.le <= 380 THEN b.le + 1 WHEN class IN ('half', 'nine') THEN p.s END AS fy_start,
       CASE WHEN h.fs IS NOT NULL THEN h.fe WHEN p.e - b.le <= 380 THEN (b.le + INTERVAL 12 MONTH)::DATE
            WHEN class IN ('half', 'nine') THEN (p.s + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE END AS fy_end,
       greatest(1, least(4, CAST(round((p.e - fy_start + 1) / 91.3125) AS INTEGER))) AS slot
FROM p LEFT JOIN held h ON h.id = p.id LEFT JOIN before b ON b.id = p.id"""),
    # What each fiscal year of an item tells: (k, true) sums of its first k quarters, (k, false) single quarters.
    ("told", """
SELECT cik, statement, line_item, unit, company_type, fy_start, max(fy_end) AS fy_end, slot AS k, false AS is_sum, any_value(val) AS v, any_value(s) AS s, any_value(e) AS e, count(*) AS n
FROM placed WHERE kind = 'duration' AND class = 'quarterly' AND fy_start IS NOT NULL GROUP BY ALL
UNION ALL
SELECT cik, statement, line_item, unit, company_type, fy_start, max(fy_end), CASE class WHEN 'half' THEN 2 WHEN 'nine' THEN 3 ELSE 4 END AS k, true, any_value(val), any_value(s), any_value(e), count(*)
FROM placed WHERE kind = 'duration' AND class <> 'quarterly' AND abs(s - fy_start) <= 7 GROUP BY ALL"""),
    ("grid", """
SELECT cik, statement, line_item, unit, company_type, fy_start, max(fy_end) AS fy_end,
       max(v) FILTER (NOT is_sum AND k = 1 AND n = 1) AS q1, max(v) FILTER (NOT is_sum AND k = 2 AND n = 1) AS q2,
       max(v) FILTER (NOT is_sum AND k = 3 AND n = 1) AS q3, max(v) FILTER (NOT is_sum AND k = 4 AND n = 1) AS q4,
       max(v) FILTER (NOT is_sum AND k = 1 AND n = 1 AND abs(s - fy_start) <= 7) AS y1,
       max(v) FILTER (is_sum AND k = 2 AND n = 1) AS y2, max(v) FILTER (is_sum AND k = 3 AND n = 1) AS y3, max(v) FILTER (is_sum AND k = 4 AND n = 1) AS y4,
       list(k) FILTER (NOT is_sum) AS reported, max(e) FILTER (is_sum AND k = 2) AS e2, max(e) FILTER (is_sum AND k = 3) AS e3, max(e) FILTER (is_sum AND k = 4) AS e4,
       max(s) FILTER (NOT is_sum AND k = 2) AS s2, max(s) FILTER (NOT is_sum AND k = 3) AS s3, max(s) FILTER (NOT is_sum AND k = 4) AS s4
FROM told GROUP BY cik, statement, line_item, unit, company_type, fy_start"""),
    # Sums from all ways there are, reported quarters first; money has at most two places here, so rounding makes it exact.
    ("solved", """
SELECT *, coalesce(y1 + q2, y2) AS f2, coalesce(y1 + q2 + q3, y3, f2 + q3) AS f3, coalesce(y4, f3 + q4) AS f4,
       coalesce(f3, f4 - q4) AS z3, coalesce(f2, z3 - q3) AS z2, coalesce(y1, z2 - q2) AS z1 FROM grid"""),
    ("derived", """
SELECT cik, statement, line_item, unit, company_type, fy_end, unnest([
         {k: 1, v: round(z1, 2), e: s2 - 1}, {k: 2, v: round(z2 - z1, 2), e: coalesce(e2, s3 - 1)},
         {k: 3, v: round(z3 - z2, 2), e: coalesce(e3, s4 - 1)}, {k: 4, v: round(f4 - z3, 2), e: e4}]) AS d, reported FROM solved"""),
]

_STD_FINAL = """
SELECT cik, statement, e AS period_ending, CAST(year(CASE WHEN class = 'annual' OR fy_end IS NULL THEN e ELSE fy_end END - 7) AS INTEGER) AS fiscal_year,
       CASE WHEN class = 'annual' THEN 'FY' WHEN slot IS NOT NULL AND fy_start IS NOT NULL THEN 'Q' || slot WHEN regexp_matches(fp, '^Q[1-4]$') THEN fp
            ELSE 'Q' || quarter(e) END AS fiscal_period, class AS frequency, line_item AS tag, val,
       CASE WHEN regexp_matches(unit, '^[A-Z]{3}$') THEN unit END AS currency, company_type, namespace || ':' || tag AS source
FROM placed WHERE class IN ('annual', 'quarterly')
UNION ALL
SELECT cik, statement, d.e, CAST(year(fy_end - 7) AS INTEGER), 'Q' || d.k, 'quarterly', line_item, d.v, CASE WHEN regexp_matches(unit, '^[A-Z]{3}$') THEN unit END,
       company_type, 'derived: ' || line_item || ' (Q' || d.k || ')'
FROM derived WHERE d.v IS NOT NULL AND d.e IS NOT NULL AND NOT coalesce(list_contains(reported, d.k), false)"""


@query("standardize_facts", "L6 (rules, priority, period class, fiscal years, year-to-date) A11", sql(["fx_doc"], EXPLODE_CTES + _STD_CTES, _STD_FINAL))
def standardize_facts(c):
    rules = literal_table(c.spark, FIXTURE_STD_RULES, sd.RULE_SCHEMA)
    return sd.standardize(facts(c).drop("event_id"), rules)


# A company's files before and after a delta, by company number: 5 vanishes, 6 is emptied, 7 is new, 8 had half of its
# documents; the others stay.
def _snapshots(c):
    f = c.stored("facts")
    part = F.col("cik").cast("long") % 11
    old = f.where((part != 7) & ((part != 8) | (F.col("event_id") % 2 == 0)))
    delta = f.where(part.isin(7, 8))
    changed = f.where(part.isin(5, 6, 7, 8)).select("cik").distinct()
    return old, delta, changed


@query("incremental_equals_full", "K5 L2 L5 L6 L7 (derived tables after a delta of new, changed, emptied and vanished companies)",
       sql(["fx_doc"], EXPLODE_CTES[:-1] + [("all_facts", EXPLODE_CTES[-1][1]), ("facts_left", "SELECT * FROM all_facts WHERE CAST(cik AS BIGINT) % 11 NOT IN (5, 6)"),
           ("statement_of", "SELECT * FROM (VALUES " + ", ".join(map(str, FIXTURE_STATEMENT_RULES)) + ") v(statement, tag)"),
           ("done", """
SELECT cik FROM facts_left JOIN statement_of USING (tag) WHERE namespace IN ('us-gaap', 'ifrs-full') GROUP BY cik HAVING count(DISTINCT statement) = 3"""),
           ("facts", "SELECT * FROM facts_left SEMI JOIN done USING (cik)")] + _STD_CTES + [("std", _STD_FINAL)], """
SELECT 'standardized' AS derived, cik, statement || ' ' || tag || ' ' || frequency || ' ' || fiscal_year || fiscal_period AS item,
       CAST(period_ending AS VARCHAR) AS detail, val FROM std
UNION ALL SELECT 'processed', cik, NULL, NULL, NULL FROM done
UNION ALL SELECT 'companies', cik, arg_max(entity_name, event_id), NULL, NULL FROM facts_left GROUP BY cik
UNION ALL SELECT 'tags', cik, namespace || ':' || tag, arg_min(label, event_id), min(event_id) FROM facts_left GROUP BY cik, namespace, tag
UNION ALL SELECT 'presentation', NULL, company_type || ' ' || statement || ' ' || tag, NULL, count(DISTINCT cik) FROM std GROUP BY company_type, statement, tag"""))
def incremental_equals_full(c):
    old, delta, changed = _snapshots(c)
    rules, std_rules = statement_rules(c.spark), literal_table(c.spark, FIXTURE_STD_RULES, sd.RULE_SCHEMA)
    t = inc.apply_delta(inc.company_tables(old, rules, std_rules, "event_id"), inc.company_tables(delta, rules, std_rules, "event_id"), changed)
    text, none, num = (lambda x: x.cast("string")), F.lit(None).cast("string"), F.lit(None).cast("double")
    std = t["standardized_statements"].select(
        F.lit("standardized").alias("derived"), "cik", F.concat_ws(" ", "statement", "tag", "frequency", F.concat(text(F.col("fiscal_year")), "fiscal_period")).alias("item"),
        text(F.col("period_ending")).alias("detail"), "val")
    rows = [std, t["processed_ciks"].select(F.lit("processed"), "cik", none, none, num),
            t["companies"].select(F.lit("companies"), "cik", "entity_name", none, num),
            t["cik_tags"].select(F.lit("tags"), "cik", F.concat_ws(":", "namespace", "tag"), "label", F.col("first_seen").cast("double")),
            inc.presentation_of(t["std_lines"]).select(F.lit("presentation"), none, F.concat_ws(" ", *sd.PRESENTATION_KEYS), none, F.col("companies").cast("double"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# Line items of the filed periods in ``fx_ytd``.
FISCAL_RULES = [
    ("industrial", "income_statement", "total_revenue", 1, "us-gaap", "Revenues", "duration"),
    ("industrial", "cash_flow", "net_cash_from_operating_activities", 1, "us-gaap", "CashFromOperations", "duration"),
]


def ytd_facts(c):
    return c["fx_ytd"].withColumnsRenamed({"start_date": "start", "end_date": "end"})


# The oracles don't take sums apart: they read the quarters that the filed sums were made of.
@query("quarters_from_ytd", "L6 (year-to-date series by quarter; December, January, June and 52/53-week years)", sql(["fx_fyear"], [], """
SELECT cik, 'CashFromOperations' AS tag, fy_start, 2 AS slot, e2 AS period_ending, CAST(v2 AS DOUBLE) AS val FROM fx_fyear WHERE CAST(cik AS INT) % 5 <> 0
UNION ALL SELECT cik, 'CashFromOperations', fy_start, 3, e3, CAST(v3 AS DOUBLE) FROM fx_fyear WHERE CAST(cik AS INT) % 5 <> 0
UNION ALL SELECT cik, t.tag, fy_start, 4, fy_end, CAST(v4 AS DOUBLE) FROM fx_fyear, (VALUES ('CashFromOperations'), ('Revenues')) t(tag) WHERE v4 IS NOT NULL"""))
def quarters_from_ytd(c):
    p = ytd_facts(c).withColumn("class", periods.period_class(F.col("start"), F.col("end")))
    placed = periods.in_fiscal_year(p, periods.fiscal_years(p))
    d = periods.quarters_from_ytd(placed, ["cik", "tag", "unit"])
    return d.select("cik", "tag", "fy_start", "slot", F.col("end").alias("period_ending"), "val")


@query("fiscal_statements", "L6 (annual and quarterly rows labelled by the fiscal year that holds them)", sql(["fx_fyear"], [
    ("y", "SELECT *, CAST(year(fy_end - 7) AS INTEGER) AS fiscal_year, CAST(cik AS INT) % 5 <> 0 AS has_half FROM fx_fyear"),
    ("r", """
SELECT cik, 'income_statement' AS statement, unnest([(e1, 'Q1', v1), (e2, 'Q2', v2), (e3, 'Q3', v3), (fy_end, 'Q4', v4), (fy_end, 'FY', v1 + v2 + v3 + v4)]) AS x,
       fiscal_year, 'total_revenue' AS tag, ['Q4'] AS derived, 'Revenues' AS reported, true AS has_half FROM y
UNION ALL
SELECT cik, 'cash_flow', unnest([(e1, 'Q1', v1), (e2, 'Q2', v2), (e3, 'Q3', v3), (fy_end, 'Q4', v4), (fy_end, 'FY', v1 + v2 + v3 + v4)]),
       fiscal_year, 'net_cash_from_operating_activities', ['Q2', 'Q3', 'Q4'], 'CashFromOperations', has_half FROM y"""),
], """
SELECT cik, statement, x[1] AS period_ending, fiscal_year, x[2] AS fiscal_period, if(x[2] = 'FY', 'annual', 'quarterly') AS frequency, tag,
       CAST(x[3] AS DOUBLE) AS val, 'USD' AS currency, 'industrial' AS company_type,
       if(list_contains(derived, x[2]), 'derived: ' || tag || ' (' || x[2] || ')', 'us-gaap:' || reported) AS source
FROM r WHERE x[3] IS NOT NULL AND (has_half OR x[2] NOT IN ('Q2', 'Q3'))"""))
def fiscal_statements(c):
    return sd.standardize(ytd_facts(c), literal_table(c.spark, FISCAL_RULES, sd.RULE_SCHEMA))


# Fixture presentation rows (company_type, statement, tag, label, description, parent, sequence, factor,
# balance, unit) for the fixture line items; goodwill and financial templates have none (defaults apply).
FIXTURE_PRESENTATION = [
    ("industrial", "income_statement", "total_revenue", "Total Revenue", "Revenue from operations", None, 1, "+",
     "credit", "monetary"),
    ("industrial", "income_statement", "total_cost_of_revenue", "Cost of Revenue", "", "total_revenue", 2, "-",
     "debit", "monetary"),
    ("industrial", "income_statement", "net_income", "Net Income", "Profit after tax", None, 9, "+", "credit",
     "monetary"),
    ("industrial", "balance_sheet", "total_assets", "Total Assets", "", None, 1, "+", "debit", "monetary"),
    ("insurance", "balance_sheet", "total_assets", "Total Assets", "Insurer assets", None, 1, "+", "debit",
     "monetary"),
]
_PRES_COLS = ["company_type", "statement", "tag", "label", "description", "parent", "sequence", "factor", "balance",
              "unit"]
_PRES_TYPES = ["VARCHAR"] * 6 + ["INTEGER"] + ["VARCHAR"] * 3


@query("standardized_statements", "M2 D3 L7", sql(["fx_std", "fx_source"], [
    ("pres", dims.values_sql(FIXTURE_PRESENTATION, _PRES_COLS, _PRES_TYPES)),
    ("s", """SELECT * FROM fx_std WHERE frequency = 'annual'
             AND statement IN ('income_statement', 'balance_sheet', 'cash_flow')"""),
    ("ct", """SELECT cik, arg_max(company_type, (period_ending, company_type)) AS ct FROM s
              WHERE company_type IS NOT NULL AND company_type <> '' GROUP BY cik"""),
], """
SELECT s.cik, coalesce(ct.ct, 'industrial') AS company_type, s.statement, strftime(s.period_ending, '%Y-%m-%d') AS period_ending,
       s.fiscal_period, s.fiscal_year, s.currency, s.tag, s.val AS value, coalesce(src.source, '') AS source,
       coalesce(p.label, s.tag) AS label, coalesce(p.description, '') AS description, p.parent, p.sequence,
       coalesce(p.factor, '+') AS factor, coalesce(p.balance, '') AS balance, coalesce(p.unit, 'monetary') AS unit
FROM s LEFT JOIN ct ON ct.cik = s.cik
LEFT JOIN pres p ON p.company_type = coalesce(ct.ct, 'industrial') AND p.statement = s.statement AND p.tag = s.tag
LEFT JOIN fx_source src ON src.cik = s.cik AND src.statement = s.statement AND src.tag = s.tag
     AND src.period_ending = s.period_ending"""))
def standardized_statements(c):
    pres = literal_table(c.spark, FIXTURE_PRESENTATION, ", ".join(
        f"{n} {'int' if t == 'INTEGER' else 'string'}" for n, t in zip(_PRES_COLS, _PRES_TYPES)))
    return sd.standardized_statements(c["fx_std"], pres, c["fx_source"], "annual")


@query("merge_registrants", "L13 (related registrants folded by priority)",
       sql(["fx_std", "fx_companies", "fx_multi_cik"], _CANON_CTES + [
           ("pr", "SELECT cik, min(priority) AS prio FROM fx_multi_cik GROUP BY cik"),
           ("s", """
SELECT coalesce(c.primary_cik, s.cik) AS primary_cik, s.*, coalesce(pr.prio, 2147483647) AS prio
FROM fx_std s LEFT JOIN canon c ON c.cik = s.cik LEFT JOIN pr ON pr.cik = s.cik"""),
           ("p", """
SELECT *, row_number() OVER (PARTITION BY primary_cik, statement, tag, period_ending, fiscal_year, fiscal_period,
                                          frequency ORDER BY prio ASC, cik ASC) AS rn FROM s"""),
       ], """
SELECT primary_cik AS cik, cik AS source_cik, statement, tag, period_ending, fiscal_year, fiscal_period, frequency,
       val, currency, company_type FROM p WHERE rn = 1"""))
def merge_registrants(c):
    return sd.merge_registrants(c["fx_std"], c["cik_canonical"], c["fx_multi_cik"].select("cik", "priority"))


_TTM_CTES = [
    ("r", """
SELECT *, CAST(SUM(CAST(val AS DECIMAL(38,4))) OVER w AS DOUBLE) AS s4, COUNT(val) OVER w AS n4, m - MIN(m) FILTER (WHERE val IS NOT NULL) OVER w AS span
FROM (SELECT *, year(period_ending) * 12 + month(period_ending) AS m FROM fx_std WHERE frequency = 'quarterly') q
WINDOW w AS (PARTITION BY cik, statement, tag ORDER BY m RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)"""),
    ("t", "SELECT *, CASE WHEN statement = 'balance_sheet' THEN val WHEN n4 = 4 AND span >= 8 THEN s4 END AS sum4 FROM r"),
]


@query("ttm_statements", "M20 L6 (TTM = four quarters within one year's span)", sql(["fx_std"], _TTM_CTES, """
SELECT cik, statement, period_ending, fiscal_year, fiscal_period, 'ttm' AS frequency, tag, sum4 AS val, currency, company_type
FROM t WHERE sum4 IS NOT NULL"""))
def ttm_statements(c):
    return sd.ttm(c["fx_std"])


_VIEW_LIMIT = 8


@query("statement_views", "M19 M20 (period x transform matrix, TTM growth)", sql(["fx_std", "fx_rates"], _TTM_CTES + [
    ("usd_rates", "SELECT from_currency AS currency, rate_date, max(rate) AS rate FROM fx_rates WHERE to_currency = 'USD' GROUP BY ALL"),
    ("series", """
SELECT CASE frequency WHEN 'annual' THEN 'FY' ELSE 'Q' END AS period, cik, tag, period_ending, val, currency
FROM fx_std WHERE statement = 'income_statement'
UNION ALL SELECT 'TTM', cik, tag, period_ending, sum4, currency FROM t WHERE statement = 'income_statement' AND sum4 IS NOT NULL"""),
    ("numbered", "SELECT *, dense_rank() OVER (PARTITION BY period, cik ORDER BY period_ending) AS idx FROM series"),
    ("steps", "SELECT * FROM (VALUES ('FY', '% YoY', 1), ('FY', '% PoP', 1), ('Q', '% YoY', 4), ('Q', '% PoP', 1), ('TTM', '% YoY', 4), ('TTM', '% PoP', 1)) v(period, transform, step)"),
    ("views", """
SELECT period, transform, n.cik, n.tag, n.period_ending, round((n.val - b.val) / abs(b.val), 4) + 0.0 AS value
FROM numbered n JOIN steps USING (period) JOIN numbered b USING (period, cik, tag)
WHERE b.idx = n.idx - step AND n.val IS NOT NULL AND b.val <> 0
UNION ALL
SELECT period, 'None', cik, tag, period_ending, val * coalesce(rate, 1) FROM series ASOF LEFT JOIN usd_rates
  ON series.currency = usd_rates.currency AND usd_rates.currency <> 'USD' AND period_ending >= rate_date"""),
], f"""
SELECT *, CAST(dense_rank() OVER (PARTITION BY period, transform, cik ORDER BY period_ending DESC) AS INTEGER) AS period_rank
FROM views QUALIFY period_rank <= {_VIEW_LIMIT}"""))
def statement_views(c):
    return st.statement_views(c["fx_std"], c["fx_calendar"], "income_statement", _VIEW_LIMIT)


@query("latest_period", "M25 C1", sql(["fx_std"], [], """
SELECT max(period_ending) AS latest_period FROM fx_std
WHERE statement = 'income_statement' AND tag = 'net_income' AND val IS NOT NULL AND frequency = 'annual'"""))
def latest_period(c):
    return sets.latest_period(c["fx_std"], "income_statement", "net_income", "annual")


@query("latest_metric_set", "M26 F1", sql(["fx_std"], [], """
SELECT cik, arg_max(val, (fiscal_year, period_ending, val)) AS val
FROM fx_std WHERE (tag, frequency) = ('net_income', 'annual') AND val IS NOT NULL GROUP BY cik"""))
def latest_metric_set(c):
    return sets.latest_metric(c["fx_std"], "net_income")


@query("revenue_set", "M26 (revenue preference)", sql(["fx_std"], [], """
SELECT cik, arg_max(val, (fiscal_year, period_ending, tag = 'total_revenue', val)) AS revenue
FROM fx_std WHERE frequency = 'annual' AND tag IN ('operating_revenue', 'total_revenue') AND val <> 0 GROUP BY cik"""))
def revenue_set(c):
    return sets.latest_revenue(c["fx_std"])


def _any_of(tags, test):
    """Companies with a recent annual value that passes ``test`` for one of ``tags``."""
    return sql(["fx_std"], [], f"""
SELECT cik FROM fx_std WHERE period_ending >= {R} AND frequency = 'annual' GROUP BY cik
HAVING bool_or({test} AND list_contains({list(tags)}, tag))""")


@query("has_revenue_set", "M26 E11", _any_of(sets.HAS_REVENUE_TAGS, "val <> 0"))
def has_revenue_set(c):
    return sets.companies_with_any(c["fx_std"], sets.HAS_REVENUE_TAGS, as_of=AS_OF)


@query("productive_set", "M26 E11", _any_of(sets.PRODUCTIVE_TAGS, "val > 0"))
def productive_set(c):
    return sets.companies_with_any(c["fx_std"], sets.PRODUCTIVE_TAGS, positive=True, as_of=AS_OF)


@query("canonical_payload_hash", "I12 K1 (content hash independent of key order)", sql(["fx_doc"], EXPLODE_CTES[:-1] + [
    # Each fixture document has one period; its keys and those of its tag are put in order by hand.
    ("period", """
SELECT event_id, j, namespace, tag, tj, unit, '{' || array_to_string(list_transform(list_sort(json_keys(p)), lambda k: '"' || k || '":' ||
         CASE k WHEN 'val' THEN rtrim(rtrim(printf('%.2f', CAST(p->>'$.val' AS DOUBLE)), '0'), '.')
                ELSE CAST(json_extract(p, '$."' || k || '"') AS VARCHAR) END), ',') || '}' AS record FROM d5"""),
], """
SELECT event_id, sha256(payload) AS raw_sha256, sha256(concat('{"cik":', j->>'$.cik', ',"entityName":"', j->>'$.entityName', '","facts":{"', namespace,
         '":{"', tag, '":{"description":"', tj->>'$.description', '","label":"', tj->>'$.label', '","units":{"', unit, '":[', record, ']}}}}}')) AS canonical_sha256
FROM period JOIN fx_doc USING (event_id)"""))
def canonical_payload_hash(c):
    d = c["fx_doc"]
    return d.select("event_id", F.sha2(F.encode("payload", "UTF-8"), 256).alias("raw_sha256"),
                    canonical_json_sha256(F.col("payload")).alias("canonical_sha256"))
