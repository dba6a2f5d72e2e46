"""Dates and times: parts, truncation, epochs and strftime."""

from __future__ import annotations

import re

from sparkloom.functions._macro import literal, macro, quoted

_TS = "CAST({0} AS TIMESTAMP_NTZ)"

#: Units of date_trunc by alias, and how each truncates {0} (a TIMESTAMP_NTZ).
_NATIVE = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
_YEARS = {"decade": 10, "century": 100, "millennium": 1000}
# Other names of units.
_ALIASES = {
    "us": "microsecond", "usec": "microsecond", "usecs": "microsecond", "microseconds": "microsecond", "ms": "millisecond", "msec": "millisecond",
    "msecs": "millisecond", "milliseconds": "millisecond", "s": "second", "sec": "second", "secs": "second", "seconds": "second", "m": "minute",
    "min": "minute", "mins": "minute", "minutes": "minute", "h": "hour", "hr": "hour", "hrs": "hour", "hours": "hour", "d": "day", "days": "day",
    "dayofmonth": "day", "w": "week", "weeks": "week", "weekofyear": "week", "mon": "month", "mons": "month", "months": "month", "quarters": "quarter",
    "y": "year", "yr": "year", "yrs": "year", "years": "year", "dec": "decade", "decs": "decade", "decades": "decade", "cent": "century",
    "c": "century", "centuries": "century", "mil": "millennium", "mils": "millennium", "millennia": "millennium", "millenium": "millennium",
    "weekday": "dow", "dayofweek": "dow", "dayofyear": "doy",
}


def unit(name: str) -> str:
    name = name.lower()
    return _ALIASES.get(name, name)


def _date_trunc(args: list[str]) -> str:
    part, x = unit(literal(args[0])), f"({args[1]})"
    ts = f"CAST({x} AS TIMESTAMP_NTZ)"
    if part in _NATIVE:
        return f"CAST(date_trunc('{part}', {ts}) AS TIMESTAMP_NTZ)"
    if part in ("dow", "isodow", "doy"):
        return f"CAST(date_trunc('day', {ts}) AS TIMESTAMP_NTZ)"
    if part == "isoyear":
        first = f"make_date(extract(YEAROFWEEK FROM {x}), 1, 4)"
        return f"CAST(date_trunc('week', CAST({first} AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)"
    if part in _YEARS:
        n = _YEARS[part]
        year = f"CAST(floor(year({x}) / {n}) * {n} AS INT)"
        return f"CAST(make_date({year}, 1, 1) AS TIMESTAMP_NTZ)"
    raise ValueError(f"unknown part {part}")


_MICROS = "unix_micros(CAST(CAST({0} AS TIMESTAMP_NTZ) AS TIMESTAMP))"
#: Parts of a moment as BIGINT (epoch and julian as DOUBLE).
PARTS = {
    "year": "year({0})", "month": "month({0})", "day": "day({0})", "hour": f"hour({_TS})", "minute": f"minute({_TS})",
    "second": f"pmod(floor({_MICROS} / 1000000), 60)",
    "millisecond": f"pmod(floor({_MICROS} / 1000), 60000)",
    "microsecond": f"pmod({_MICROS}, 60000000)",
    "quarter": "quarter({0})", "week": "weekofyear({0})", "doy": "dayofyear({0})",
    "dow": "dayofweek({0}) - 1", "isodow": "weekday({0}) + 1", "isoyear": "extract(YEAROFWEEK FROM {0})",
    "yearweek": "extract(YEAROFWEEK FROM {0}) * 100 + weekofyear({0})",
    "decade": "floor(year({0}) / 10)", "century": "CASE WHEN year({0}) > 0 THEN floor((year({0}) - 1) / 100) + 1 ELSE -floor((-year({0})) / 100) - 1 END",
    "millennium": "CASE WHEN year({0}) > 0 THEN floor((year({0}) - 1) / 1000) + 1 ELSE -floor((-year({0})) / 1000) - 1 END",
    "era": "CASE WHEN year({0}) > 0 THEN 1 ELSE 0 END",
}


def _date_part(args: list[str]) -> str:
    part, x = unit(literal(args[0])), f"({args[1]})"
    if part == "epoch":
        return f"({_MICROS.format(x)} / 1000000.0D)"
    if part not in PARTS:
        raise ValueError(f"unknown part {part}")
    return f"CAST({PARTS[part].format(x)} AS BIGINT)"


# date_format patterns of strftime codes.
_CODES = {
    "d": "dd", "m": "MM", "Y": "yyyy", "y": "yy", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "a": "EEE", "A": "EEEE",
    "b": "MMM", "h": "MMM", "B": "MMMM", "p": "a", "I": "hh", "c": "yyyy-MM-dd HH:mm:ss", "x": "yyyy-MM-dd", "X": "HH:mm:ss", "T": "HH:mm:ss",
}
#: strftime codes that are worked out instead.
_WORKED = {
    "n": "lpad(CAST(pmod({m}, 1000000) * 1000 AS STRING), 9, '0')",
    "u": "CAST(weekday({0}) + 1 AS STRING)",
    "w": "CAST(dayofweek({0}) - 1 AS STRING)",
    "U": "lpad(CAST(CAST(floor((dayofyear({0}) - 1 - (dayofweek({0}) - 1) + 7) / 7) AS INT) AS STRING), 2, '0')",
    "W": "lpad(CAST(CAST(floor((dayofyear({0}) - 1 - weekday({0}) + 7) / 7) AS INT) AS STRING), 2, '0')",
    "V": "lpad(CAST(weekofyear({0}) AS STRING), 2, '0')",
    "G": "lpad(CAST(extract(YEAROFWEEK FROM {0}) AS STRING), 4, '0')",
    "g": "lpad(CAST(extract(YEAROFWEEK FROM {0}) % 100 AS STRING), 2, '0')",
    "z": "'+00'",
    "Z": "''",
}


def _strftime(args: list[str]) -> str:
    """strftime(moment, format); the format is a literal."""
    if args[0].strip().startswith("'"):  # the format may come first
        args = [args[1], args[0]]
    x, pattern = f"({args[0]})", literal(args[1])
    ts = f"CAST({x} AS TIMESTAMP_NTZ)"
    parts, plain, k = [], "", 0

    def flush() -> None:
        nonlocal plain
        if plain:
            parts.append(quoted(plain))
            plain = ""

    while k < len(pattern):
        ch = pattern[k]
        if ch != "%":
            plain += ch
            k += 1
            continue
        code = pattern[k + 1 : k + 2]
        k += 2
        short = code == "-"
        if short:
            code = pattern[k : k + 1]
            k += 1
        if code == "%":
            plain += "%"
        elif code in _CODES:
            flush()
            text = f"date_format({ts}, {quoted(_CODES[code])})"
            parts.append(f"CAST(CAST({text} AS INT) AS STRING)" if short else text)
        elif code in _WORKED:
            flush()
            parts.append(_WORKED[code].format(x, m=_MICROS.format(x)))
        else:
            raise ValueError(f"Unrecognized format for strftime: %{code}")
    flush()
    return f"CASE WHEN {x} IS NOT NULL THEN concat({', '.join(parts) or quoted('')}) END"


# -- the row dialect: moments with modifiers ----------------------------------------------

_SHIFT = re.compile(r"([+-]?\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?")
_CLOCK = re.compile(r"([+-])(\d\d):(\d\d)(?::(\d\d))?")
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _months(ts: str, n: str) -> str:
    """Months added; days that the month does not have run over into the next."""
    first = f"add_months(CAST(trunc({ts}, 'MM') AS DATE), {n})"
    time = f"({_MICROS.format(ts)} - unix_micros(CAST(date_trunc('DAY', {ts}) AS TIMESTAMP)))"
    return f"CAST(timestamp_micros(unix_micros(CAST({first} AS TIMESTAMP)) + (day({ts}) - 1) * 86400000000 + {time}) AS TIMESTAMP_NTZ)"


def _plus(ts: str, micros: str) -> str:
    return f"CAST(timestamp_micros({_MICROS.format(ts)} + {micros}) AS TIMESTAMP_NTZ)"


def _modified(args: list[str]) -> str:
    """A moment and its modifiers (literals) as a TIMESTAMP_NTZ; what is no moment is NULL."""
    x, modifiers = f"({args[0]})", [literal(a).strip().lower() for a in args[1:]]
    number = f"CASE WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double') OR typeof({x}) LIKE 'decimal%' THEN try_cast(CAST({x} AS STRING) AS DOUBLE) END"
    if modifiers[:1] in (["unixepoch"], ["auto"]):
        scale = f"CAST(round(({number}) * 1000000) AS BIGINT)"
        if modifiers[0] == "auto":  # julian days if they can be
            scale = f"CASE WHEN ({number}) BETWEEN 0 AND 5373484.5 THEN CAST(round((({number}) - 2440587.5D) * 86400000) AS BIGINT) * 1000 ELSE {scale} END"
        modifiers = modifiers[1:]
    else:
        scale = f"CAST(round((({number}) - 2440587.5D) * 86400000) AS BIGINT) * 1000"
    ts = f"coalesce(CAST(timestamp_micros({scale}) AS TIMESTAMP_NTZ), CASE WHEN typeof({x}) IN ('string', 'date', 'timestamp', 'timestamp_ntz') THEN try_cast(CAST({x} AS STRING) AS TIMESTAMP_NTZ) END)"
    for m in modifiers:
        if m in ("utc", "localtime", "subsec", "subsecond"):  # all moments are UTC
            continue
        if m.startswith("start of "):
            ts = f"CAST(date_trunc('{m[9:].upper()}', {ts}) AS TIMESTAMP_NTZ)"
        elif m.startswith("weekday "):
            ts = _plus(ts, f"pmod({int(m[8:])} - (dayofweek({ts}) - 1), 7) * 86400000000")
        elif shift := _SHIFT.fullmatch(m):
            n, unit_ = shift[1], shift[2]
            if unit_ in _SECONDS:
                ts = _plus(ts, f"({round(float(n) * _SECONDS[unit_] * 1_000_000)})")
            else:
                ts = _months(ts, str(int(float(n)) * (12 if unit_ == "year" else 1)))
        elif clock := _CLOCK.fullmatch(m):
            n = (int(clock[2]) * 3600 + int(clock[3]) * 60 + int(clock[4] or 0)) * (-1 if clock[1] == "-" else 1)
            ts = _plus(ts, f"({n * 1_000_000})")
        else:
            raise ValueError(f"unknown modifier {m}")
    return ts


def _moment(template: str):
    """A function of a moment with modifiers."""
    return lambda args: f"({template.format(_modified(args))})"


def _row_strftime(args: list[str]) -> str:
    """strftime(moment, format), or the row dialect's strftime(format, moment, modifiers ...)."""
    if len(args) == 2 and not args[0].strip().startswith("'"):
        return _strftime(args)
    return _strftime([_modified(args[1:]) if len(args) > 2 else args[1], args[0]])


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _timediff(args: list[str]) -> str:
    """What has to be added to the second moment to get the first, as ``+YYYY-MM-DD HH:MM:SS.SSS``."""
    whole = "((year(p.late) - year(p.early)) * 12 + month(p.late) - month(p.early))"
    # months that end beyond the later moment are too many; short months may take two off
    too_many = [f"CASE WHEN {_months('p.early', f'(m.n - {k})')} > p.late THEN 1 ELSE 0 END" for k in (0, 1)]
    months = f"m.n - {too_many[0]} * (1 + {too_many[1]})"
    text = (
        "concat(CASE WHEN p.back THEN '-' ELSE '+' END, lpad(CAST(r.n div 12 AS STRING), 4, '0'), '-', lpad(CAST(r.n % 12 AS STRING), 2, '0'), '-', "
        "lpad(CAST(r.rest div 86400000000 AS STRING), 2, '0'), ' ', date_format(CAST(timestamp_micros(r.rest % 86400000000) AS TIMESTAMP_NTZ), 'HH:mm:ss.SSS'))"
    )
    rest = f"({_MICROS.format('p.late')} - {_MICROS.format(_months('p.early', 'k.n'))})"
    body = _let("m", f"named_struct('n', CAST({whole} AS INT))", _let("k", f"named_struct('n', CAST({months} AS INT))", _let("r", f"named_struct('n', k.n, 'rest', {rest})", text)))
    pair = _let("o", f"named_struct('a', {_modified(args[:1])}, 'b', {_modified(args[1:])})", _let("p", "named_struct('late', greatest(o.a, o.b), 'early', least(o.a, o.b), 'back', o.a < o.b, 'known', o.a IS NOT NULL AND o.b IS NOT NULL)", f"CASE WHEN p.known THEN {body} END"))
    return f"({pair})"


FUNCTIONS = {
    "date_trunc": _date_trunc,
    "datetrunc": _date_trunc,
    "date_part": _date_part,
    "datepart": _date_part,
    "strftime": _row_strftime,
    "epoch": macro(f"{_MICROS} / 1000000.0D"),
    "epoch_ms": macro(f"CAST(floor({_MICROS} / 1000) AS BIGINT)"),
    "epoch_us": macro(_MICROS),
    "epoch_ns": macro(f"{_MICROS} * 1000"),
    "date": lambda a: f"CAST({a[0]} AS DATE)" if len(a) == 1 else _moment("date_format({0}, 'yyyy-MM-dd')")(a),
    "julianday": _moment(f"{_MICROS} / 86400000000.0D + 2440587.5D"),
    "unixepoch": _moment(f"CAST(floor({_MICROS} / 1000000) AS BIGINT)"),
    "datetime": _moment("date_format({0}, 'yyyy-MM-dd HH:mm:ss')"),
    "time": _moment("date_format({0}, 'HH:mm:ss')"),
    "timediff": _timediff,
} | {name: (lambda a, name=name: _date_part([f"'{name}'", a[0]])) for name in ("year", "month", "day", "hour", "minute", "second", "quarter", "week", "dayofweek", "dayofyear", "isodow", "isoyear", "decade", "century", "millennium", "yearweek", "weekday", "weekofyear", "dayofmonth", "millisecond", "microsecond", "era")}
