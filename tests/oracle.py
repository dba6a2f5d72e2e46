"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

from sparkloom.session import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else str(path) + '/*.parquet'}'")
    return con


def plain(v: object) -> object:
    """A value that compares across engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    return v


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, or nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = Counter(tuple(plain(v) for _, v in sorted(zip(names, row))) for row in result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    ours = Counter(tuple(plain(v) for _, v in sorted(zip(df.columns, row))) for row in df.collect())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows, expected {sum(theirs.values())}; ours {list((ours - theirs).items())[:2]}, theirs {list((theirs - ours).items())[:2]}"
