"""Rows of a query and of its oracle in comparable form."""

from __future__ import annotations

import decimal
import math
import os

import duckdb


def database(sf: str):
    con = duckdb.connect()
    for file in os.listdir(sf):
        path = f"{sf}/{file}" + ("/*.parquet" if os.path.isdir(f"{sf}/{file}") else "")
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    return str(v)[:26] if hasattr(v, "isoformat") else str(v)


def same(df, con, sql: str) -> None:
    rel = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want
