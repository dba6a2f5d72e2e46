"""Log files: format detection and parsers, in Column expressions.

A parsed line has the columns timestamp (nanoseconds), observed_ts, severity (OTel
number), severity_text, facility, message, raw, format, and a map ``fields`` with all
other keys as texts.  The parsers need no Python for a line, so they run alike over
batch and streaming inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the well-known keys, of severities and of syslog facilities.
ALIASES = {
    "timestamp": ("ts", "time", "timestamp", "@timestamp", "date", "datetime"),
    "level": ("level", "severity", "lvl", "log_level", "loglevel"),
    "message": ("msg", "message", "text", "body"),
    "host": ("host", "hostname", "server"),
    "service": ("service", "app", "application", "name", "program"),
    "pid": ("pid", "process_id"),
}
SEVERITIES = {
    1: ("trace", "trc", "verbose"),
    5: ("debug", "dbg"),
    9: ("info", "information", "notice"),
    13: ("warn", "warning"),
    17: ("error", "err", "severe"),
    21: ("fatal", "critical", "crit", "panic", "emerg", "alert"),
}
SEVERITY_TEXT = {1: "TRACE", 5: "DEBUG", 9: "INFO", 13: "WARN", 17: "ERROR", 21: "FATAL"}
NUMBERED = {10: 1, 20: 5, 30: 9, 40: 13, 50: 17, 60: 21}
SYSLOG_SEVERITY = (21, 21, 21, 17, 13, 9, 9, 5)
FACILITIES = (
    "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp audit alert clock "
    "local0 local1 local2 local3 local4 local5 local6 local7"
).split()

_SYSLOG = r"^\s*<(\d{1,3})>([A-Z][a-z]{2})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?:? ?(.*)$"
_CLF = r'^\s*(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
_PAIR = r'([A-Za-z_@][\w.@/-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
_CRI = r"^(\S+) (stdout|stderr) ([FP]) (.*)$"

SAMPLE_LINES, LOCK_ON = 32, 0.8


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def severity_of(text: Column) -> Column:
    """The number of a severity's name or of a level like 30."""
    names = {name: n for n, all_ in SEVERITIES.items() for name in all_}
    return F.coalesce(_lookup(names, F.lower(F.trim(text))), _lookup({str(k): v for k, v in NUMBERED.items()}, F.trim(text)))


def epoch_nanos(text: Column) -> Column:
    """Nanoseconds of an ISO 8601 moment, or of an epoch number by its count of digits."""
    t = F.trim(text)
    iso = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9})\d*)?\s*(Z|z|[+-]\d{2}:?\d{2})?"
    moment = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(t, iso, 1), F.regexp_extract(t, iso, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_extract(t, iso, 4)
    shift = F.when(
        zone.rlike(r"^[+-]"),
        F.when(zone.startswith("-"), -1).otherwise(1)
        * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, -2, 2).try_cast("int") * 60),
    ).otherwise(0)
    part = F.rpad(F.regexp_extract(t, iso, 3), 9, "0").try_cast("bigint")
    from_iso = (F.unix_seconds(moment) - shift) * 1_000_000_000 + F.coalesce(part, F.lit(0))
    digits = F.length(F.ltrim(t, F.lit("-")))
    unit = _lookup({10: 1_000_000_000, 13: 1_000_000, 16: 1_000, 19: 1}, digits)
    number = F.when(t.rlike(r"^-?\d{10,19}$"), t.try_cast("bigint") * unit.cast("bigint"))
    return F.when(t.rlike(iso), from_iso).otherwise(number)


def format_of(line: Column) -> Column:
    """json, syslog, clf, logfmt or freeform: what a single line looks like."""
    return (
        F.when(line.rlike(r"^\s*\{"), F.lit("json"))
        .when(line.rlike(r"^\s*<\d{1,3}>"), F.lit("syslog"))
        .when(line.rlike(r"^\s*\d{1,3}(?:\.\d{1,3}){3} .*\["), F.lit("clf"))
        .when(F.size(F.regexp_extract_all(line, F.lit(_PAIR), F.lit(0))) >= 2, F.lit("logfmt"))
        .otherwise(F.lit("freeform"))
    )


def unwrapped(line: Column) -> tuple[Column, Column, Column]:
    """The payload of a container line, the container (docker, cri or null) and its time."""
    log = F.get_json_object(line, "$.log")
    # plain searches first: most lines have no wrapping, and JSON is parsed for those only that can have one
    docker = line.contains('"stream"') & line.contains('"log"') & line.rlike(r"^\s*\{") & log.isNotNull() & F.get_json_object(line, "$.stream").isNotNull()
    cri = (line.contains(" stdout ") | line.contains(" stderr ")) & line.rlike(_CRI)
    payload = F.when(docker, F.rtrim(log, F.lit("\n"))).when(cri, F.regexp_extract(line, _CRI, 4)).otherwise(line)
    kind = F.when(docker, F.lit("docker")).when(cri, F.lit("cri"))
    when = F.when(docker, F.get_json_object(line, "$.time")).when(cri, F.regexp_extract(line, _CRI, 1))
    return payload, kind, when


def detect(lines: DataFrame, column: str = "value") -> str | None:
    """The format that at least 80 % of the first 32 lines have; None where lines differ."""
    payload, _, _ = unwrapped(F.col(column))
    seen = [r.f for r in lines.limit(SAMPLE_LINES).select(format_of(payload).alias("f")).collect()]
    for f in set(seen):
        if seen.count(f) >= LOCK_ON * len(seen):
            return f
    return None


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _canonical(entries: Column) -> Column:
    """A map of (key, value) entries under the well-known names; of two with one name the first counts.

    Well-known timestamps, levels and messages without a value don't count at all.
    """
    names = {a: w for w, aliases in ALIASES.items() for a in aliases}
    lead = F.array(*[F.lit(w) for w in ("timestamp", "level", "message")])
    named = F.transform(entries, lambda e: F.struct(F.coalesce(_lookup(names, F.lower(e["key"])), e["key"]).alias("key"), e["value"].alias("value")))

    def first(given: Column) -> Column:
        keys = F.transform(given, lambda e: e["key"])
        return _let(keys, lambda ks: F.filter(given, lambda e, k: F.array_position(ks, e["key"]) == k + 1))

    def of(es: Column) -> Column:
        # names that come twice are rare: only then each is looked up among those before it
        once = F.size(F.array_distinct(F.transform(es, lambda e: e["key"]))) == F.size(es)
        given = F.filter(es, lambda e: e["value"].isNotNull() | ~F.array_contains(lead, e["key"]))
        return F.when(once, F.map_from_entries(es)).otherwise(F.map_from_entries(_let(given, first)))

    return _let(named, of)


def _syslog(line: Column, year: int) -> dict[str, Column]:
    g = lambda k: F.regexp_extract(line, _SYSLOG, k)
    pri = g(1).try_cast("int")
    moment = F.try_to_timestamp(F.concat_ws(" ", F.lit(str(year)), g(2), F.lpad(g(3), 2, "0"), g(4)), F.lit("yyyy MMM dd HH:mm:ss"))
    severity = F.try_element_at(F.array(*[F.lit(s) for s in SYSLOG_SEVERITY]), pri % 8 + 1)
    facility = F.try_element_at(F.array(*[F.lit(f) for f in FACILITIES]), F.floor(pri / 8).cast("int") + 1)
    return {
        "timestamp": F.unix_seconds(moment) * 1_000_000_000,
        "severity": severity,
        "facility": facility,
        "message": g(8),
        "fields": F.map_filter(F.create_map(F.lit("host"), g(5), F.lit("service"), g(6), F.lit("pid"), g(7)), lambda k, v: v != ""),
    }


def _clf(line: Column) -> dict[str, Column]:
    g = lambda k: F.regexp_extract(line, _CLF, k)
    named = {
        "host": g(1), "ident": g(2), "user": g(3), "method": F.regexp_extract(g(5), r"^(\S+)", 1), "path": F.regexp_extract(g(5), r"^\S+ (\S+)", 1),
        "protocol": F.regexp_extract(g(5), r"(\S+/\S+)$", 1), "status": g(6), "bytes": g(7), "referer": g(8), "user_agent": g(9),
    }
    moment = F.try_to_timestamp(g(4), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    fields = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)])
    return {
        "timestamp": F.unix_seconds(moment) * 1_000_000_000,
        "severity": F.lit(None).cast("int"),  # an access log states none
        "facility": F.lit(None).cast("string"),
        "message": g(5),
        "fields": F.map_filter(fields, lambda k, v: (v != "") & (v != "-")),
    }


def _promoted(fields: Column) -> dict[str, Column]:
    return {
        "timestamp": epoch_nanos(F.try_element_at(fields, F.lit("timestamp"))),
        "severity": severity_of(F.try_element_at(fields, F.lit("level"))),
        "facility": F.lit(None).cast("string"),
        "message": F.try_element_at(fields, F.lit("message")),
        "fields": F.map_filter(fields, lambda k, v: ~k.isin("timestamp", "level", "message")),
    }


def _json(line: Column) -> Column:
    """Keys of the object and, behind a dot, of objects in it; arrays stay JSON text."""
    options = {"allowUnquotedControlChars": "true"}
    top = F.map_entries(F.coalesce(F.from_json(line, "map<string,string>", options), F.create_map().cast("map<string,string>")))
    is_object = lambda e: F.coalesce(e["value"].startswith("{"), F.lit(False))

    def inner(e: Column) -> Column:
        dotted = F.transform(
            F.map_entries(F.from_json(e["value"], "map<string,string>", options)),
            lambda i: F.struct(F.concat(e["key"], F.lit("."), i["key"]).alias("key"), i["value"].alias("value")),
        )
        return F.when(is_object(e), F.filter(dotted, lambda i: ~is_object(i))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    def of(entries: Column) -> Column:
        return _canonical(F.when(F.exists(entries, is_object), F.flatten(F.transform(entries, inner))).otherwise(entries))

    return _let(top, of)


def _logfmt(line: Column) -> Column:
    """Keys with their values, quotes and escapes taken off."""
    pairs = F.regexp_extract_all(line, F.lit(_PAIR), F.lit(0))

    def entry(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        value = p.substr(F.length(key) + 2, F.length(p))
        inside = F.regexp_replace(value.substr(F.lit(2), F.length(value) - 2), r"\\(.)", "$1")
        return F.struct(key.alias("key"), F.when(value.startswith('"'), inside).otherwise(value).alias("value"))

    return _canonical(F.transform(pairs, entry))


def _freeform(line: Column) -> dict[str, Column]:
    null = F.lit(None)
    return {
        "timestamp": null.cast("bigint"), "severity": null.cast("int"), "facility": null.cast("string"), "message": line,
        "fields": F.create_map().cast("map<string,string>"),
    }


def parse(lines: DataFrame, column: str = "value", format: str | None = None, year: int = 2024, observed: Column | None = None) -> DataFrame:
    """Parsed lines; each line by its own format unless ``format`` says which.

    ``year`` completes syslog times.  ``observed`` is when a line came in (nanoseconds;
    by default its own time).  Container wrappings are taken off first.
    """
    payload, container, when = unwrapped(F.col(column))
    line = F.col("__payload")
    # generators of one element: what stands in them is worked out once for a line
    wrapped = F.struct(payload.alias("p"), container.alias("k"), when.alias("w"))
    base = lines.select(F.col(column).alias("raw"), F.explode(F.array(wrapped)).alias("__w"))
    base = base.select("raw", F.col("__w.p").alias("__payload"), F.col("__w.k").alias("__kind"), F.col("__w.w").alias("__when"))
    base = base.withColumn("format", F.lit(format) if format else format_of(line))
    keyed = F.when(F.col("format") == "json", _json(line)).when(F.col("format") == "logfmt", _logfmt(line))
    if format in (None, "json", "logfmt"):
        base = base.select("*", F.explode(F.array(keyed)).alias("__fields"))
    fields = F.col("__fields")
    parsers = {"syslog": lambda: _syslog(line, year), "clf": lambda: _clf(line), "freeform": lambda: _freeform(line)}
    parsers |= {"json": lambda: _promoted(fields), "logfmt": lambda: _promoted(fields)}
    made = {f: parsers[f]() for f in ([format] if format else parsers)}

    def pick(what: str) -> Column:
        out = F
        for f, columns in made.items():
            out = out.when(F.col("format") == f, columns[what])
        return out

    out = base.select("raw", "format", "__kind", "__when", *[pick(w).alias(w) for w in ("timestamp", "severity", "facility", "message", "fields")])
    extra = F.when(F.col("__kind").isNotNull(), F.map_concat(F.map_filter("fields", lambda k, v: ~k.isin("container", "container_time")), F.create_map(F.lit("container"), F.col("__kind"), F.lit("container_time"), F.col("__when"))))
    stamp = F.coalesce(F.col("timestamp"), epoch_nanos(F.col("__when")))
    return out.select(
        stamp.alias("timestamp"), (observed if observed is not None else stamp).alias("observed_ts"), "severity",
        _lookup(SEVERITY_TEXT, F.col("severity")).alias("severity_text"), "facility", "message", "raw", "format",
        F.coalesce(extra, F.col("fields")).alias("fields"),
    )


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of a log file or folder, parsed (see :func:`parse`)."""
    lines = spark.read.text(path)
    return parse(lines, format=detect(lines), **options)


def follow(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """New files of a folder of log files as a stream of parsed lines."""
    return parse(spark.readStream.text(path), format=format, **options)


def with_severity_names(predicate: str) -> str:
    """``severity >= 'WARN'`` with the number in place of the name."""
    import re

    numbers = {name: n for n, all_ in SEVERITIES.items() for name in all_}

    def number(m: re.Match) -> str:
        n = numbers.get(m[2].lower())
        return m[0] if n is None else f"{m[1]}{n}"

    return re.sub(r"(\bseverity\s*(?:=|<>|!=|<=|>=|<|>)\s*)'(\w+)'", number, predicate, flags=re.IGNORECASE)
