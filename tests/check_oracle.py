"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows.

    python tests/check_oracle.py [sf] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402
from lineforge.session import local_session  # noqa: E402

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


DUCK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in rows)


def compare(spark, con, folder, name):
    """Returns (matches, message)."""
    started = time.time()
    df = QUERIES[name](spark, folder)
    got = df.collect()
    took = time.time() - started
    if name not in ORACLES:
        return bool(got), f"{len(got)} rows, no SQL ({took:.1f}s)"
    found = con.sql(ORACLES[name])
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = rows_of(df.columns, got), rows_of(names, found.fetchall())
    if left != right:
        only_left = sorted(set(left) - set(right))[:2]
        only_right = sorted(set(right) - set(left))[:2]
        return False, f"{len(left)} rows against {len(right)}\n  spark {only_left}\n  duck  {only_right}"
    types = {f.name: DUCK_TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    wanted = {n: str(t) for n, t in zip(names, found.types)}
    if types != wanted:
        return False, f"types {[(n, types[n], wanted[n]) for n in types if types[n] != wanted[n]]}"
    return True, f"{len(got)} rows ({took:.1f}s)"


def main() -> int:
    args = sys.argv[1:]
    folder = f"/root/testdata/{args[0] if args else 'sf0.01'}"
    spark, con = local_session("8"), duck(folder)
    failed = 0
    for name in args[1:] or list(QUERIES):
        try:
            ok, message = compare(spark, con, folder, name)
        except Exception as problem:  # report and go on
            ok, message = False, str(problem)[:700]
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {message}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
