"""JSON functions over texts; malformed JSON gives NULL.

``json`` and ``json5_extract`` read JSON5, the others JSON.
"""

from __future__ import annotations

import re

from sparkloom.functions._macro import literal, macro, quoted


def steps(arg: str) -> list[str | int]:
    """A path literal as Spark's paths with a position from the end (negative) between each two."""
    p = literal(arg)
    if p.startswith("/"):
        p = "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in p[1:].split("/"))
    elif not p.startswith("$"):
        p = f"$.{p}"
    out: list[str | int] = []
    for k, part in enumerate(re.split(r"\[#(?:-(\d+))?\]", p)):
        if k % 2:
            out.append(-int(part or 0))
        else:
            out.append(re.sub(r'\."([^"]*)"', lambda m: f"['{m[1]}']", part if k == 0 else f"${part}"))
    return out


def path(arg: str) -> str:
    """A path literal without positions from the end, as Spark reads it."""
    own = steps(arg)
    if len(own) > 1:
        raise ValueError("positions from the end are not possible here")
    return own[0]


def _at(value: str, own: list[str | int]) -> str:
    """The element of a variant at the end of :func:`steps`, as a variant."""
    for step in own:
        if isinstance(step, int):
            # behind the last one there is nothing
            value = f"try_element_at(try_cast({value} AS ARRAY<VARIANT>), {step})" if step else "CAST(NULL AS VARIANT)"
        elif step != "$":
            value = f"try_variant_get({value}, {quoted(step)}, 'variant')"
    return value


def _plain(value: str) -> str:
    """A variant as text: strings without quotes, all else as JSON; null is NULL."""
    return f"CASE WHEN schema_of_variant({value}) = 'VOID' THEN NULL ELSE coalesce(CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_cast({value} AS STRING) END, to_json({value})) END"


def _extract_string(args: list[str]) -> str:
    own = steps(args[1])
    if len(own) == 1:
        return f"get_json_object({args[0]}, {quoted(own[0])})"
    return _plain(_at(f"try_parse_json({args[0]})", own))


def _extract(args: list[str]) -> str:
    """The element as JSON text: strings stay quoted."""
    return f"CAST(to_json({_at(f'try_parse_json({args[0]})', steps(args[1]))}) AS STRING)"


def _variant(args: list[str]) -> str:
    v = f"try_parse_json({args[0]})"
    return _at(v, steps(args[1])) if len(args) > 1 else v


_STRINGS = r"""("(?:[^"\\\\]|\\\\.)*"|'(?:[^'\\\\]|\\\\.)*')"""


def json5(args: list[str]) -> str:
    """A variant from JSON with comments, bare and single-quoted names, trailing commas, signs and points of numbers."""
    x = args[0]
    rules = (
        (_STRINGS + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1"),
        (_STRINGS + r"|,(?=\s*[}\]])", "$1"),
        (_STRINGS + r"|(?<=[:\[,\s])\+(?=[\d.])", "$1"),
        (_STRINGS + r"|(?<=\d)\.(?=[,}\]\s]|$)", "$1"),
    )
    for pattern, by in rules:
        x = f"regexp_replace({x}, {quoted(pattern.replace(chr(92) * 4, chr(92) * 2))}, {quoted(by)})"
    x = f"regexp_replace({x}, {quoted('(?<=[:,' + chr(92) + '[' + chr(92) + 's-])' + chr(92) + '.(?=' + chr(92) + 'd)')}, '0.')"
    return f"coalesce(try_parse_json({args[0]}), from_json({x}, 'variant', map('allowUnquotedFieldNames', 'true', 'allowSingleQuotes', 'true')))"


def _type(args: list[str]) -> str:
    """DuckDB's names of JSON types."""
    s = f"schema_of_variant({_variant(args)})"
    return (
        f"CASE WHEN {s} LIKE 'OBJECT%' THEN 'OBJECT' WHEN {s} LIKE 'ARRAY%' THEN 'ARRAY' WHEN {s} = 'STRING' THEN 'VARCHAR' "
        f"WHEN {s} = 'BOOLEAN' THEN 'BOOLEAN' WHEN {s} = 'VOID' THEN 'NULL' WHEN {s} = 'BIGINT' THEN CASE WHEN to_json({_variant(args)}) LIKE '-%' THEN 'BIGINT' ELSE 'UBIGINT' END "
        f"WHEN {s} IS NULL THEN NULL ELSE 'DOUBLE' END"
    )


def _keys(args: list[str]) -> str:
    return f"json_object_keys({args[0]})" if len(args) == 1 else f"json_object_keys(get_json_object({args[0]}, {quoted(path(args[1]))}))"


def _array_length(args: list[str]) -> str:
    x = args[0] if len(args) == 1 else f"get_json_object({args[0]}, {quoted(path(args[1]))})"
    return f"CAST(json_array_length({x}) AS BIGINT)"


def _elements(args: list[str]) -> str:
    """The elements of an array as a list of texts."""
    v = _variant(args)
    return f"transform(try_cast({v} AS ARRAY<VARIANT>), e -> coalesce(try_cast(e AS STRING), to_json(e)))"


def _object(args: list[str]) -> str:
    return f"to_json(named_struct({', '.join(args)}), map('ignoreNullFields', 'false'))" if args else "'{}'"


FUNCTIONS = {
    "json_extract_string": _extract_string,
    "json_extract": _extract,
    "json_keys": _keys,
    "json_array_length": _array_length,
    "json_array_elements_text": _elements,
    "json_type": _type,
    "json_valid": macro("try_parse_json({0}) IS NOT NULL"),
    "json": lambda a: f"to_json({json5(a)})",
    "json5_extract": lambda a: f"CAST(to_json({_at(json5(a), steps(a[1]))}) AS STRING)",
    "json_array": lambda a: "concat('[', concat_ws(',', " + ", ".join(f"coalesce(substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2), 'null')" for x in a) + "), ']')",
    "json_object": _object,
    "json_quote": macro("coalesce(substr(to_json(array({0})), 2, length(to_json(array({0}))) - 2), 'null')"),
}
