"""SQLite files as tables, for queries of their own and joins with other sources."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.session import ship


def _kind(declared: str) -> T.DataType:
    """The Spark type of a declared type, by the affinity rules."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d or not d:
        return T.BinaryType() if d else T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    if "BOOL" in d:
        return T.BooleanType()
    return T.DoubleType()


def _convert(value: object, kind: T.DataType) -> object:
    """A cell as its column's type: numbers in texts are read, others become text."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.LongType):
            return int(value)
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.BooleanType):
            return bool(value)
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


def read(spark: SparkSession, path: str, table: str, rows_per_range: int = 100_000) -> DataFrame:
    """A table of a SQLite file; ranges of row ids are read by different tasks.

    The file must be reachable by all executors under the same path.
    """
    ship(spark)
    quoted = table.replace('"', '""')
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        columns = [(r[1], _kind(r[2])) for r in con.execute(f'PRAGMA table_info("{quoted}")')]
        if not columns:
            raise ValueError(f"no table {table} in {path}")
        try:
            lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{quoted}"').fetchone()
            ranges = [(k, k + rows_per_range) for k in range(lo, hi + 1, rows_per_range)] if lo is not None else []
        except sqlite3.OperationalError:  # a table without row ids
            ranges = [(None, None)]
    schema = T.StructType([T.StructField(n, k) for n, k in columns])

    def fetch(batches):
        import pandas as pd

        names = [n for n, _ in columns]
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    where = "" if pd.isna(a) else f" WHERE rowid >= {int(a)} AND rowid < {int(b)}"
                    rows = con.execute(f'SELECT * FROM "{quoted}"{where}').fetchall()
                data = {n: pd.Series([_convert(r[k], kind) for r in rows], dtype=object) for k, (n, kind) in enumerate(columns)}
                yield pd.DataFrame(data, columns=names)

    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(ranges, "a bigint, b bigint").repartition(len(ranges)).mapInPandas(fetch, schema)


def attach(spark: SparkSession, path: str, name: str | None = None) -> list[str]:
    """Views for all tables and views of a file, as ``table`` or ``name_table``; returns their names."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    made = []
    for t in tables:
        view = f"{name}_{t}" if name else t
        read(spark, path, t).createOrReplaceTempView(view)
        made.append(view)
    return made


def detach(spark: SparkSession, names: list[str]) -> None:
    for n in names:
        spark.catalog.dropTempView(n)
