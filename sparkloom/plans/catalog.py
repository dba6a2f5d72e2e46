"""All registered queries of the library by name, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.plans import further, moving, relational
from sparkloom.session import TABLES, register
from sparkloom.sql import query

Query = Callable[[SparkSession, str], DataFrame]


def _of(text: str) -> Query:
    names = [t for t in TABLES if t in text]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, names)
        return query(spark, text)

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary: scan, filter, partial and final aggregation, sort."""
    return _of(relational.REPORTS["report_pricing"])(spark, sf_dir)


_TEXT = relational.QUERIES | further.TEXT
_CALLS = moving.QUERIES | further.CALLS


def queries() -> dict[str, Query]:
    return {k: _of(v if isinstance(v, str) else v[0]) for k, v in _TEXT.items()} | {k: f for k, (f, _) in _CALLS.items()}


def oracle_sql() -> dict[str, str]:
    plain = {k: v if isinstance(v, str) else v[1] for k, v in _TEXT.items()}
    return plain | {k: sql for k, (_, sql) in _CALLS.items() if sql}
