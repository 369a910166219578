"""Rows of a Spark query and of DuckDB in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import os
from pathlib import Path

import duckdb


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return "[" + ",".join(map(value, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{str(path) + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(query, sql: str, spark, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cursor = connection(sf_dir).execute(sql)
    want = normal(cursor.fetchall(), [c[0] for c in cursor.description])
    assert got == want
