"""Single-node reference point: the oracle SQL of every query run by DuckDB over the
same fixture tables, materialised once (like bench.py's store), as are the derived tables that bench.py stores:
exploded facts, canonical companies, processed companies, classification. Prints one JSON line.

usage: python tools/duckdb_baseline.py [sf_dir]
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from finfacts.plans import all_queries, q_company, q_ingest, q_sector  # noqa: E402
from finfacts.plans.fixtures import FIXTURES, RAW_TABLES  # noqa: E402
from finfacts.plans.registry import REGISTRY  # noqa: E402


# Queries that derive a stored table themselves, in Spark too.
BUILDERS = {"facts_explode", "incremental_equals_full", "processed_companies", "canonical_ciks", "classify_industry"}


def main():
    sf_dir = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1").rstrip("/")
    all_queries.load()
    con = duckdb.connect()
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    t0 = time.time()
    for name, _deps, body in FIXTURES:
        con.execute(f"CREATE TABLE {name} AS {body}")
    # The queries' own CTEs of these names are left out below, so that they read the tables.
    stored = {"facts": q_ingest.EXPLODE_CTES, "processed": q_ingest._PROCESSED_CTES, "canon": q_company._CANON_CTES,
              "classified": q_sector.CLASSIFY_CTES}
    for name, ctes in stored.items():
        con.execute(f"CREATE TABLE {name} AS WITH RECURSIVE " + ", ".join(f"{n} AS ({b})" for n, b in ctes) + f" SELECT * FROM {name}")
    setup = time.time() - t0
    times = {}
    for name, q in REGISTRY.items():
        if not q.oracle:
            continue
        ctes = list(q.oracle.ctes)
        if name not in BUILDERS:
            ctes = [(n, b) for n, b in ctes if n not in stored]      # CTEs that only these read aren't run
        text = ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" if ctes else "") + q.oracle.final
        samples = []
        for _ in range(2):
            t = time.time()
            con.execute(text).fetchall()
            samples.append(time.time() - t)
        times[name] = round(statistics.median(samples), 4)
    print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "setup_sec": round(setup, 3),
                      "value": round(sum(times.values()), 3), "queries": times}))


if __name__ == "__main__":
    main()
