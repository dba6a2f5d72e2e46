"""Scalar functions with DuckDB's answers, as expressions of built-in Spark functions.

Every function is a macro: it gets its arguments as Spark SQL text and returns Spark
SQL text, so calls vanish before Catalyst plans and no Python runs for a row.
"""

from __future__ import annotations

from collections.abc import Callable

from sparkloom.functions import dates, json, json_edit, lists, logfmt, maps, numbers, text

MACROS: dict[str, Callable[[list[str]], str]] = {}
for _module in (numbers, text, dates, lists, maps, json, json_edit, logfmt):
    MACROS |= _module.FUNCTIONS
