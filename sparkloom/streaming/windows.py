"""Tumbling range vectors with watermarks, over tables and over streams.

``count_over_time``, ``sum_over_time``, ``avg_over_time``, ``min_over_time``,
``max_over_time`` and ``rate`` of a column in windows of one size, aligned to the
epoch.  The watermark stands one window size behind the latest event; a row is late
when its window ends at or before it.  Over a table the latest event is that of the
whole input.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def seconds(text: str) -> int:
    """``5 m``, ``90s`` or ``1 day`` in seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in UNITS and m[2] != "":
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * UNITS[m[2]]


def nanos(column: str | Column, df: DataFrame) -> Column:
    """A time column as nanoseconds: numbers are taken as such, moments are converted."""
    c = F.col(column) if isinstance(column, str) else column
    kind = df.select(c.alias("c")).schema["c"].dataType.simpleString()
    return c if kind == "bigint" else F.unix_micros(c.cast("timestamp")) * 1000


def window_start(time: Column, size_s: int) -> Column:
    """The start (nanoseconds) of the window that holds a time."""
    size = F.lit(size_s * 1_000_000_000)
    return time - F.pmod(time, size)


def aggregate(function: str, column: str | None, size_s: int) -> Column:
    """One of the functions over the rows of a window."""
    x = None if column in (None, "*") else F.col(column)
    counted = F.count(F.lit(1)) if x is None else F.count(x)
    number = None if x is None else x.cast("double")
    if function == "count_over_time":
        return counted
    if function == "rate":
        return counted / F.lit(float(size_s))
    if x is None:
        raise ValueError(f"{function} needs a column")
    by = {"sum_over_time": F.coalesce(F.sum(number), F.lit(0.0)), "avg_over_time": F.avg(number), "min_over_time": F.min(number), "max_over_time": F.max(number)}
    return by[function]


def _marked(df: DataFrame, time: str, size_s: int) -> DataFrame:
    t = nanos(time, df)
    latest = df.agg(F.max(t).alias("__latest"))  # one row, whatever the size of the input
    out = df.withColumn("window_start", window_start(t, size_s)).crossJoin(F.broadcast(latest))
    size = size_s * 1_000_000_000
    return out.withColumn("__late", F.col("window_start") + size <= F.col("__latest") - size)


def on_time(df: DataFrame, time: str, size_s: int) -> DataFrame:
    """Rows whose window is open, with ``window_start``."""
    return _marked(df, time, size_s).where(~F.col("__late")).drop("__late", "__latest")


def late(df: DataFrame, time: str, size_s: int) -> DataFrame:
    """Rows that came late, with ``window_start``."""
    return _marked(df, time, size_s).where("__late").drop("__late", "__latest")


def range_vector(df: DataFrame, time: str, size_s: int, functions: dict[str, tuple[str, str | None]], watermark: bool = True) -> DataFrame:
    """Rows ``window_start`` and one column for each of ``functions`` (name: function, column)."""
    rows = on_time(df, time, size_s) if watermark else df.withColumn("window_start", window_start(nanos(time, df), size_s))
    return rows.groupBy("window_start").agg(*[aggregate(f, c, size_s).alias(name) for name, (f, c) in functions.items()])


def range_vector_stream(stream: DataFrame, time: str, size_s: int, functions: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The same over a stream, to be written in append mode: a window comes out when it closes."""
    moment = F.col(time)
    if stream.schema[time].dataType.simpleString() == "bigint":
        moment = F.timestamp_micros(F.floor(moment / 1000))
    rows = stream.withColumn("__t", moment.cast("timestamp")).withWatermark("__t", f"{size_s} seconds")
    out = rows.groupBy(F.window("__t", f"{size_s} seconds").alias("w")).agg(*[aggregate(f, c, size_s).alias(n) for n, (f, c) in functions.items()])
    return out.select((F.unix_micros("w.start") * 1000).alias("window_start"), *functions)


def scope(df: DataFrame, time: str, since: str | None = None, until: str | None = None, now_ns: int | None = None) -> DataFrame:
    """Rows between ``since`` and ``until`` ago (durations; row-exact), or the last ``n lines``.

    ``now_ns`` is the present in nanoseconds; by default the latest event.
    """
    t = nanos(time, df)
    if since and (m := re.fullmatch(r"\s*(\d+)\s*lines?\s*", since)):
        return df.orderBy(t.desc_nulls_last()).limit(int(m[1]))
    now = F.lit(now_ns) if now_ns is not None else F.col("__now")
    out = df if now_ns is not None else df.crossJoin(F.broadcast(df.agg(F.max(t).alias("__now"))))
    if since:
        out = out.where(t >= now - seconds(since) * 1_000_000_000)
    if until:
        out = out.where(t <= now - seconds(until) * 1_000_000_000)
    return out.drop("__now")


def last_bytes(df: DataFrame, time: str, text: str, size: int) -> DataFrame:
    """The latest rows whose texts (with line ends) make up at most ``size`` bytes.

    Bytes are first summed by minute; only the minute in which the budget ends is
    ordered row by row.
    """
    from pyspark.sql import Window

    t = nanos(time, df)
    given = df.withColumn("__t", t).withColumn("__b", F.octet_length(text) + 1).withColumn("__m", F.floor(t / 60_000_000_000))
    minutes = given.groupBy("__m").agg(F.sum("__b").alias("s"))
    # one row a minute: a running sum over it stays small
    ahead = minutes.withColumn("before", F.sum("s").over(Window.orderBy(F.desc("__m"))) - F.col("s")).where(F.col("before") <= size)
    near = given.join(F.broadcast(ahead), "__m")
    within = F.sum("__b").over(Window.partitionBy("__m").orderBy(F.desc("__t")))
    return near.where(F.col("before") + F.col("s") <= size).drop("__t", "__b", "__m", "s", "before").unionByName(
        near.where(F.col("before") + F.col("s") > size).withColumn("__w", within).where(F.col("before") + F.col("__w") <= size).drop("__t", "__b", "__m", "s", "before", "__w")
    )


def report(df: DataFrame, time: str) -> dict:
    """Lines and first and last time of what a query saw."""
    t = nanos(time, df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last")).first()
    return {"lines": row["n"], "first_ts": row["first"], "last_ts": row["last"]}


_RANGE = re.compile(r"^\s*select\s+(\w+)\s*\(\s*(\*|\w+)\s*\)\s*range\s+(\d+\s*\w+?)\s*(?:as\s+(\w+)\s*)?from\s+(\w+)(.*)$", re.IGNORECASE | re.DOTALL)
_SCOPE = re.compile(r"\b(since|until)\s+(all\b|\d+\s*[a-z]+)", re.IGNORECASE)
_SIZE = re.compile(r"\s*(\d+)\s*(b|kb|mb|gb)\s*", re.IGNORECASE)
#: What a log query sees if it does not say.
DEFAULT_SCOPE = "1 h"


class UnboundedQuery(ValueError):
    """A statement that would have to hold all of a log."""


def _refuse(sql: str, unbounded: bool) -> None:
    """Joins, and over all of a log what cannot answer before its end and has no bound."""
    plain = re.sub(r"'(?:[^']|'')*'", "''", sql).upper()
    if re.search(r"\bJOIN\b", plain):
        raise UnboundedQuery("a log query does not join; use sparkloom.streaming.joins")
    if unbounded:
        for words in (r"ORDER\s+BY", r"SELECT\s+DISTINCT"):
            if re.search(rf"\b{words}\b", plain) and not re.search(r"\bLIMIT\s+\d", plain):
                raise UnboundedQuery(f"{words.replace(chr(92) + 's+', ' ')} over all of a log needs a LIMIT")


def query(df: DataFrame, sql: str, time: str = "timestamp", name: str = "log", default: str | None = DEFAULT_SCOPE, text: str = "raw") -> DataFrame:
    """A statement over a log: plain SQL, or ``SELECT f(x) RANGE 5 m FROM log``, with SINCE and UNTIL.

    SINCE takes a duration, ``n lines``, a size (``10 mb`` of the column ``text``) or
    ALL; without it the last ``default`` counts.  ``severity >= 'WARN'`` compares by
    severity number.
    """
    from sparkloom.sources.logs import with_severity_names
    from sparkloom.sql import expr
    from sparkloom.sql import query as run

    bounds = {m[1].lower(): m[2] for m in _SCOPE.finditer(sql)}
    sql = with_severity_names(_SCOPE.sub("", sql))
    since = bounds.get("since", default)
    unbounded = since is None or since.lower() == "all"
    _refuse(sql, unbounded)
    if not unbounded and (size := _SIZE.fullmatch(since)):
        df = last_bytes(df, time, text, int(size[1]) << {"b": 0, "kb": 10, "mb": 20, "gb": 30}[size[2].lower()])
        since = None
    if not unbounded or bounds.get("until"):
        df = scope(df, time, None if unbounded else since, bounds.get("until"))
    if m := _RANGE.match(sql):
        function, column, size, label, _, rest = m.groups()
        rest = rest.strip()
        if rest:
            if not rest.lower().startswith("where"):
                raise ValueError("a range query takes a WHERE only")
            df = df.where(expr(rest[5:]))
        label = label or f"{function}({column})"
        return range_vector(df, time, seconds(size), {label: (function.lower(), column)})
    df.createOrReplaceTempView(name)
    return run(df.sparkSession, sql)
