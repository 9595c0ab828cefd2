"""Every registered query against its DuckDB oracle on the smallest data folder."""
import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from finfacts.plans.registry import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES = {n: q for n, q in E.queries().items() if n in REGISTRY}
ORACLE = {n: q for n, q in E.oracle_sql().items() if n in REGISTRY}


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert len(srows) > 0
        return
    cur = duck.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cik", "ticker", "name", "period_ending", "fiscal_year", "fiscal_period", "currency", "value"]
    assert df.count() >= 0


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE", "StringType()": "VARCHAR",
                 "DateType()": "DATE", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_types_match_oracle(spark, duck, name):
    st = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in QUERIES[name](spark, SMALL).schema.fields}
    rel = duck.sql(ORACLE[name])
    assert st == {c: str(t) for c, t in zip(rel.columns, rel.types)}
