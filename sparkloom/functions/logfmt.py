"""logfmt texts: key=value pairs, values bare or in double quotes."""

from __future__ import annotations

import re

from sparkloom.functions._macro import literal, quoted


def _extract(args: list[str]) -> str:
    """logfmt_extract(text, key): NULL when the key is not there."""
    key = re.escape(literal(args[1]))
    pattern = quoted(rf'(?:^|\s){key}=(?:"((?:[^"\\]|\\.)*)"|([^\s"]*))')
    x = args[0]
    inside, bare = f"regexp_extract({x}, {pattern}, 1)", f"regexp_extract({x}, {pattern}, 2)"
    value = f"CASE WHEN {inside} <> '' THEN regexp_replace({inside}, '\\\\\\\\(.)', '$1') ELSE {bare} END"
    return f"CASE WHEN {x} RLIKE {pattern} THEN {value} END"


FUNCTIONS = {"logfmt_extract": _extract}
