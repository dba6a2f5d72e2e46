"""Approximate counts and reports on plans."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The relative standard deviation of a sketch with 2**14 registers.
SKETCH_DEVIATION = 0.0081


def approx_distinct(column: str | Column) -> Column:
    """APPROX_COUNT_DISTINCT with the error of 2**14 registers."""
    return F.approx_count_distinct(column, SKETCH_DEVIATION)


def plan(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain`` prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def shuffles(df: DataFrame) -> int:
    """Exchanges in the plan (of the first plan, before it adapts)."""
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange ") or plan(df, "simple").count("Exchange ")


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach file scans."""
    return [line.split(":", 1)[1].strip() for line in plan(df).splitlines() if line.strip().startswith("PushedFilters:")]
