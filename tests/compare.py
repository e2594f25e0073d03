"""Compares a query with its SQL; run as python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def differences(spark, sf_dir: str, name: str) -> str:
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir)
    rel = views(sf_dir).sql(entry.oracle_sql()[name])
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} and {sorted(rel.columns)}"
    a, b = rows(got.columns, got.collect()), rows(rel.columns, rel.fetchall())
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; only in one: {only}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from conftest import session

    spark = session()
    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            found = differences(spark, sys.argv[1], name) or "equal"
        except Exception as e:  # noqa: BLE001
            found = f"failed: {str(e)[:1500]}"
        print(name, found, round(time.time() - began, 1), flush=True)
