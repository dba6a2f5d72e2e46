"""Joins of streams with tables and with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_table(stream: DataFrame, table: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A stream (or a log read as a table) with a lookup table; the table is the build side."""
    if how not in ("inner", "left"):
        raise ValueError("a stream keeps its side: inner and left only")
    return stream.join(table, on, how)


def between_streams(a: DataFrame, b: DataFrame, on: Column, time_a: str, time_b: str, within_s: int, late_s: int = 0) -> DataFrame:
    """Rows of two streams (or tables) that match and lie at most ``within_s`` apart.

    Watermarks bound what a stream has to remember.
    """
    if a.isStreaming:
        a = a.withWatermark(time_a, f"{late_s} seconds")
    if b.isStreaming:
        b = b.withWatermark(time_b, f"{late_s} seconds")
    gap = F.expr(f"INTERVAL {within_s} SECONDS")
    near = (F.col(time_b) >= F.col(time_a) - gap) & (F.col(time_b) <= F.col(time_a) + gap)
    return a.join(b, on & near)
