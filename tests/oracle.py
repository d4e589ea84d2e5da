"""Comparing a DataFrame with the oracle's rows: column names, row count, and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(directory)):
        if f.endswith(".parquet"):
            path = f"{directory}/{f}"
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return "NaN" if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return str(v)


def bag(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if the rows agree, else what is different."""
    ours = df.collect()
    rel = con.execute(sql)
    names, theirs = [d[0] for d in rel.description], rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    a, b = bag(df.columns, ours), bag(names, theirs)
    return None if a == b else f"first different rows: {next((x, y) for x, y in zip(a, b) if x != y)}"
