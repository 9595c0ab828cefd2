"""Registry of named queries: a Spark plan builder and its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from finfacts.plans.fixtures import FixtureCatalog, oracle_prefix


@dataclass
class Query:
    name: str
    ids: str                      # SURVEY §2 ids covered
    build: Callable[[FixtureCatalog], DataFrame]
    oracle: str | None            # DuckDB SQL; None = rows-only check


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, oracle: str | None):
    def deco(fn: Callable[[FixtureCatalog], DataFrame]):
        REGISTRY[name] = Query(name, ids, fn, oracle)
        return fn
    return deco


class OracleSQL(str):
    """Oracle text that also remembers its parts (query CTEs and final SELECT), so the
    same query can run against materialised fixture tables."""
    ctes: list
    final: str


def sql(fixtures, ctes: list[tuple[str, str]], final: str) -> str:
    """Oracle text: fixture CTEs + query CTEs + final SELECT."""
    out = OracleSQL(oracle_prefix(fixtures, ctes) + final)
    out.ctes, out.final = list(ctes), final
    return out


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REGISTRY[name].build(FixtureCatalog.get(spark, sf_dir))
    run.__name__ = f"run_{name}"
    return run
