"""Comparison of a query with its SQL counterpart: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def differences(df, con, sql: str) -> tuple[list, list]:
    rows = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    left = sorted(tuple(plain(r[c]) for c in names) for r in rows)
    right = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    if left == right:
        return [], []
    return [r for r in left if r not in set(right)][:3], [r for r in right if r not in set(left)][:3]
