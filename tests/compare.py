"""Compare a query's rows with those of its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    return value


def _sorted(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in at) for row in rows]
    return [columns[i] for i in at], sorted(plain, key=lambda row: [(v is None, str(type(v)), v) for v in row])


def differences(df, con, sql: str) -> str | None:
    """None when rows and column names agree exactly, else what differs."""
    ours = _sorted(df.columns, df.collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = _sorted(columns, cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    off = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(off)} of {len(ours[1])} rows differ, first: {off[0]}" if off else None
