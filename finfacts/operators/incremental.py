"""Tables derived from facts, kept up by company.

facts -> companies, cik_tags, processed companies -> standardized statements -> line items -> presentation. Every table
but the last is a function of one company's facts at a time, so a full build calls ``company_tables`` on all facts and a
delta on the changed companies' facts, and replaces those companies' rows. Presentation has no company: it is the
distinct line items of all companies with their definitions, taken from the (small) line-item table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.operators.delta import replace_by_key
from finfacts.operators.facts import companies_from_facts, processed_companies
from finfacts.operators.standardize import PRESENTATION_ATTRS, PRESENTATION_KEYS, presentation_dim, standardize

#: Tables keyed by cik, in the order in which they follow from each other.
COMPANY_TABLES = ("companies", "cik_tags", "processed_ciks", "standardized_statements", "std_lines")


def cik_tags(facts: DataFrame, order: str) -> DataFrame:
    """(cik, namespace, tag, label, description, first_seen): the tags a company reports, with the text of its first load."""
    seq = F.coalesce(F.col(order), F.lit(9223372036854775807))
    return facts.groupBy("cik", "namespace", "tag").agg(
        F.min_by("label", seq).alias("label"), F.min_by("description", seq).alias("description"), F.min(order).alias("first_seen"))


def std_lines(std: DataFrame) -> DataFrame:
    """(cik, company_type, statement, tag): the line items a company has."""
    return std.select("cik", *PRESENTATION_KEYS).distinct()


def company_tables(facts: DataFrame, rules: DataFrame, std_rules: DataFrame | None, order: str, written=lambda name, df: df) -> dict[str, DataFrame]:
    """Derived tables of the companies whose facts these are.

    Companies with all three statements are processed, and processed ones are standardized, in full builds and deltas
    alike; without ``std_rules`` there are no statements. ``written`` may store a table that the next one reads.
    """
    out = {"companies": companies_from_facts(facts, order), "cik_tags": cik_tags(facts, order),
           "processed_ciks": written("processed_ciks", processed_companies(facts, rules))}
    if std_rules is not None:
        std = standardize(facts.join(out["processed_ciks"].select("cik"), "cik", "left_semi"), std_rules)
        out["standardized_statements"] = written("standardized_statements", std)
        out["std_lines"] = std_lines(out["standardized_statements"])
    return out


def apply_delta(old: dict[str, DataFrame], new: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Derived tables after a delta: the rows of changed companies replaced. A changed company without facts loses its rows."""
    return {name: replace_by_key(old[name], rows, changed=changed) for name, rows in new.items()}


def presentation_of(lines: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """(company_type, statement, tag, companies, label, ...): line items in use, their number of companies and definition.

    definitions: rows of (company_type, statement, tag, label, ..., load_seq); the latest load's count, and a line item
    without one has nulls.
    """
    use = lines.groupBy(*PRESENTATION_KEYS).agg(F.count("*").alias("companies"))
    if definitions is None:
        return use.select(*PRESENTATION_KEYS, "companies", *[F.lit(None).cast("int" if a == "sequence" else "string").alias(a) for a in PRESENTATION_ATTRS])
    return use.join(presentation_dim(definitions), PRESENTATION_KEYS, "left").select(*PRESENTATION_KEYS, "companies", *PRESENTATION_ATTRS)
