"""Order-insensitive comparison of a query with its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(value) -> str:
    return type(value).__name__


def normal(value):
    if isinstance(value, decimal.Decimal):
        return ("Decimal", str(value))
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("time", value.isoformat())
    return (kind(value), str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree in columns, types and values."""
    got = rows_of(df.columns, df.collect())
    relation = con.sql(sql)
    columns = list(relation.columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    want = rows_of(columns, relation.fetchall())
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} / {len(want)} rows; columns {sorted(columns)}\n  only query: {extra}\n  only SQL:   {missing}"
