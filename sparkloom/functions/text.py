"""Text functions, and pattern translation."""

from __future__ import annotations

import re

from sparkloom.functions._macro import literal, macro, quoted, renamed


def glob_to_regex(pattern: str) -> str:
    """A GLOB pattern (``*``, ``?``, ``[a-z]``, ``[^a]``) as an anchored regular expression."""
    out, k = ["(?s)^"], 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            first = k + 1 + (pattern[k + 1 : k + 2] in ("^", "!"))
            end = pattern.find("]", first + 1)
            if end < 0:
                return "(?!)"  # an unclosed class matches nothing
            body = pattern[first:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append("[" + "^" * (first > k + 1) + body + "]")
            k = end
        else:
            out.append(re.escape(ch))
        k += 1
    return "".join(out) + "$"


def _glob(args: list[str]) -> str:
    """glob(pattern, text)"""
    return f"({args[1]} RLIKE {quoted(glob_to_regex(literal(args[0])))})"


def _substr(args: list[str]) -> str:
    s, start = f"({args[0]})", f"({args[1]})"
    if len(args) == 2:
        return f"CASE WHEN {start} = 0 THEN {s} ELSE substr({s}, {start}) END"
    n = f"({args[2]})"
    # position 0 is the one before the first; a negative length takes what stands before
    ahead = f"CASE WHEN {start} = 0 THEN substr({s}, 1, greatest({n} - 1, 0)) WHEN {start} < -length({s}) THEN substr({s}, 1, greatest({n} + {start} + length({s}), 0)) ELSE substr({s}, {start}, {n}) END"
    begin = f"CASE WHEN {start} < 0 THEN length({s}) + {start} + 1 ELSE {start} END"
    back = f"substr({s}, greatest({begin} + {n}, 1), least({begin} - 1, -{n}, {begin} - greatest({begin} + {n}, 1)))"
    return f"CASE WHEN {n} >= 0 THEN {ahead} ELSE {back} END"


def _pad(name: str):
    def expand(args: list[str]) -> str:
        fill = args[2] if len(args) > 2 else "' '"
        if fill.strip() == "''":
            raise ValueError(f"insufficient padding in {name}")
        return f"{name}({args[0]}, {args[1]}, {fill})"

    return expand


_LEFT = "CASE WHEN {1} >= 0 THEN substr({0}, 1, {1}) ELSE substr({0}, 1, greatest(length({0}) + {1}, 0)) END"
_RIGHT = "CASE WHEN {1} >= 0 THEN substr({0}, greatest(length({0}) - {1}, 0) + 1) ELSE substr({0}, -{1} + 1) END"
_SPLIT_PART = (
    "CASE WHEN {0} IS NULL OR {1} IS NULL OR {2} IS NULL THEN NULL WHEN {2} = 0 THEN '' WHEN {1} = '' THEN coalesce(try_element_at(split({0}, ''), {2}), '') ELSE split_part({0}, {1}, nullif({2}, 0)) END"
)


def _trim(name: str):
    return lambda a: f"{name}({a[0]})" if len(a) == 1 else f"trim({dict(trim='BOTH', ltrim='LEADING', rtrim='TRAILING')[name]} {a[1]} FROM {a[0]})"


def _format(args: list[str]) -> str:
    """printf: %d %i %u %s %f %e %g %x %X %o %c %% with flags, width and precision."""
    pattern = re.sub(r"%([-+ 0,#]*\d*(?:\.\d+)?)([iu])", r"%\1d", literal(args[0]))
    return f"format_string({', '.join([quoted(pattern), *args[1:]])})"


def _quote(args: list[str]) -> str:
    x = args[0]
    return f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) = 'string' THEN concat('\\'', replace(CAST({x} AS STRING), '\\'', '\\'\\''), '\\'') ELSE CAST({x} AS STRING) END"


def _typeof(args: list[str]) -> str:
    """The front door's names of types."""
    names = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "void": "NULL"}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE typeof({args[0]}) {cases} ELSE upper(typeof({args[0]})) END"


def _char(args: list[str]) -> str:
    """Characters of code points."""
    one = "decode(unhex(lpad(hex(CAST({} AS INT)), 8, '0')), 'UTF-32')"
    return "concat_ws('', " + ", ".join(one.format(f"({a})") for a in args) + ")"


FUNCTIONS = {
    "upper": macro("upper(replace({0}, 'ß', 'ẞ'))"),
    "length": macro("CAST(length({0}) AS BIGINT)"),
    # of a text or a list: the type is known when the plan is made, so one branch is left
    "len": macro(
        "CAST(CASE WHEN typeof({0}) LIKE 'array%' THEN json_array_length(get_json_object(to_json(named_struct('v', {0})), '$.v')) "
        "ELSE length(CAST({0} AS STRING)) END AS BIGINT)"
    ),
    "strlen": macro("CAST(octet_length({0}) AS BIGINT)"),
    "substr": _substr,
    "substring": _substr,
    "trim": _trim("trim"),
    "ltrim": _trim("ltrim"),
    "rtrim": _trim("rtrim"),
    "instr": macro("CAST(instr({0}, {1}) AS BIGINT)"),
    "strpos": macro("CAST(instr({0}, {1}) AS BIGINT)"),
    "concat": lambda a: "concat_ws('', " + ", ".join(f"CAST({x} AS STRING)" for x in a) + ")",
    "starts_with": renamed("startswith"),
    "ends_with": renamed("endswith"),
    "left": macro(_LEFT),
    "right": macro(_RIGHT),
    "lpad": _pad("lpad"),
    "rpad": _pad("rpad"),
    "split_part": macro(_SPLIT_PART),
    "decode": macro("decode({0}, 'UTF-8')"),
    "regexp_extract": macro("regexp_extract({0}, {1}, 0)", "regexp_extract({0}, {1}, {2})"),
    "regexp_matches": macro("{0} RLIKE {1}"),
    "glob": _glob,
    "like": macro("lower({1}) LIKE lower({0})", "lower({1}) LIKE lower({0}) ESCAPE {2}"),
    "ilike": macro("{0} ILIKE {1}"),
    "format": _format,
    "printf": _format,
    "quote": _quote,
    "char": _char,
    "chr": lambda a: _char(a),
    "unicode": macro("CAST(conv(hex(encode(substr({0}, 1, 1), 'UTF-32')), 16, 10) AS INT)"),
    "unistr": lambda a: quoted(re.sub(r"\\\\|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\\+([0-9a-fA-F]{6})|\\([0-9a-fA-F]{4})", lambda m: chr(int(next(g for g in m.groups() if g), 16)) if any(m.groups()) else "\\", literal(a[0]))),
    "typeof": _typeof,
    "randomblob": macro("substr(unhex(concat_ws('', transform(sequence(1, {0}), k -> lpad(hex(CAST(floor(rand() * 256) AS BIGINT)), 2, '0')))), 1, {0})"),
    "octet_length": macro("CAST(octet_length({0}) AS BIGINT)"),
    "sqlite_version": lambda a: "'3.51.0'",
    "sqlite_source_id": lambda a: "'none'",
    "sqlite_compileoption_used": lambda a: "0",
    "sqlite_compileoption_get": lambda a: "CAST(NULL AS STRING)",
    "zeroblob": macro("unhex(repeat('00', {0}))"),
}
