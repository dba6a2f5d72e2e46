"""Rollups: what is kept of rows that retention has dropped.

Before old rows go, their counts, sums, minima and maxima by window are added to a
small table; COUNT, SUM, MIN and MAX over all time are then answered from the rollup
and the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.streaming.windows import nanos, window_start


def rollup(df: DataFrame, time: str, size_s: int, values: list[str]) -> DataFrame:
    """One row for each window: window_start, n, and sum, min, max and count of each value."""
    given = df.withColumn("window_start", window_start(nanos(time, df), size_s))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for v in values:
        x = F.col(v).cast("double")
        aggregates += [F.count(v).alias(f"{v}_count"), F.sum(x).alias(f"{v}_sum"), F.min(x).alias(f"{v}_min"), F.max(x).alias(f"{v}_max")]
    return given.groupBy("window_start").agg(*aggregates)


def merge(parts: DataFrame, values: list[str]) -> DataFrame:
    """Rollups of the same windows added up."""
    aggregates = [F.sum("n").alias("n")]
    for v in values:
        aggregates += [F.sum(f"{v}_count").alias(f"{v}_count"), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
    return parts.groupBy("window_start").agg(*aggregates)


def evict(df: DataFrame, kept: DataFrame | None, time: str, size_s: int, values: list[str], before_ns: int) -> tuple[DataFrame, DataFrame]:
    """Rows from ``before_ns`` on, and the rollup with the rows before it added.

    ``before_ns`` is rounded down to a window's start, so no window is split.
    """
    size = size_s * 1_000_000_000
    edge = before_ns - before_ns % size
    t = nanos(time, df)
    gone = rollup(df.where(t < edge), time, size_s, values)
    merged = gone if kept is None else merge(kept.unionByName(gone), values)
    return df.where(t >= edge), merged


def totals(df: DataFrame, kept: DataFrame, time: str, size_s: int, values: list[str]) -> DataFrame:
    """COUNT, SUM, MIN and MAX over rows and rollup together: one row."""
    both = merge(kept.unionByName(rollup(df, time, size_s, values)), values)
    aggregates = [F.sum("n").alias("n")]
    for v in values:
        aggregates += [F.sum(f"{v}_sum").alias(f"{v}_sum"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max")]
    return both.agg(*aggregates)
