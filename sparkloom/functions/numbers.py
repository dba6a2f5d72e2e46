"""Arithmetic, casts to integers and mathematical functions."""

from __future__ import annotations

from sparkloom.functions._macro import macro, renamed

_INF = "CAST('Infinity' AS DOUBLE)"
_NAN = "CAST('NaN' AS DOUBLE)"


def _not_nan(template: str):
    """A function whose NaN results are NULL."""
    return macro(f"nullif({template}, {_NAN})")


def _to_integer(args: list[str]) -> str:
    """Doubles round half to even, decimals and texts half away from zero."""
    x, kind, cast = args
    return (
        f"CASE WHEN typeof({x}) IN ('double', 'float') THEN {cast}(rint(CAST({x} AS DOUBLE)) AS {kind}) "
        f"WHEN typeof({x}) LIKE 'decimal%' THEN {cast}(round({cast}({x} AS DECIMAL(38, 9)), 0) AS {kind}) "
        f"WHEN typeof({x}) = 'string' THEN {cast}(round({cast}({x} AS DECIMAL(38, 9)), 0) AS {kind}) "
        f"ELSE {cast}({x} AS {kind}) END"
    )


FUNCTIONS = {
    "__divide": macro(
        "CASE WHEN CAST({1} AS DOUBLE) <> 0 THEN CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE) "
        f"WHEN {{1}} IS NULL OR {{0}} IS NULL THEN NULL WHEN CAST({{0}} AS DOUBLE) > 0 THEN {_INF} "
        f"WHEN CAST({{0}} AS DOUBLE) < 0 THEN -{_INF} ELSE {_NAN} END"
    ),
    "__int_divide": macro("CAST({0} AS BIGINT) div nullif(CAST({1} AS BIGINT), 0)"),
    "__modulo": macro("try_mod({0}, {1})"),
    "__to_integer": _to_integer,
    "sign": macro("CAST(sign({0}) AS TINYINT)"),
    "trunc": macro("CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END"),
    "log": macro("log10({0})", "nullif(log({0}, {1}), CAST('NaN' AS DOUBLE))"),
    "ln": _not_nan("ln({0})"),
    "log2": _not_nan("log2({0})"),
    "log10": _not_nan("log10({0})"),
    "sqrt": _not_nan("sqrt({0})"),
    "acos": _not_nan("acos({0})"),
    "asin": _not_nan("asin({0})"),
    "acosh": _not_nan("acosh({0})"),
    "atanh": _not_nan("atanh({0})"),
    "mod": macro("try_mod({0}, {1})"),
    "pow": renamed("power"),
    "ifnull": renamed("coalesce"),
    "iif": renamed("if"),
    "likely": macro("{0}"),
    "unlikely": macro("{0}"),
    "likelihood": macro("CASE WHEN {1} BETWEEN 0 AND 1 THEN {0} END"),
    # the row dialect's scalar forms: null if any argument is null
    "scalar_min": lambda a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE least({', '.join(a)}) END",
    "scalar_max": lambda a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE greatest({', '.join(a)}) END",
    "total": macro("coalesce(sum(CAST({0} AS DOUBLE)), 0.0D)"),
}
# min and max of several arguments are the scalar forms
FUNCTIONS["min"] = lambda a: f"min({a[0]})" if len(a) == 1 else FUNCTIONS["scalar_min"](a)
FUNCTIONS["max"] = lambda a: f"max({a[0]})" if len(a) == 1 else FUNCTIONS["scalar_max"](a)
