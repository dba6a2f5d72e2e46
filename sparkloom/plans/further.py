"""More queries with their SQL: the row dialect, JSON and maps, SQLite files, log files, reports.

A value is (ours, DuckDB's): ours is a statement of the front door or a function.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import dml, reports, statements
from sparkloom.plans.moving import HOUR, _drained, _events_stream, _lines, scratch
from sparkloom.session import load
from sparkloom.sources import logs, parquet, sqlite
from sparkloom.sources.ingest import EventTable
from sparkloom.sql import expr, query
from sparkloom.streaming import joins, windows
from sparkloom.streaming.standing import StandingQuery

# -- statements -----------------------------------------------------------------------------

_E = "SELECT event_id, {} FROM events"
_C = "SELECT c_custkey, {} FROM customer"
_P = "SELECT p_partkey, {} FROM part"

TEXT: dict[str, str | tuple[str, str]] = {
    "join_using_multi": "SELECT l_orderkey, l_linenumber, a, b FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a FROM lineitem) x JOIN (SELECT l_orderkey, l_linenumber, l_tax AS b FROM lineitem WHERE l_tax > 0.05) y USING (l_orderkey, l_linenumber)",
    "union_join_arm": "SELECT o.o_orderkey AS k, c.c_name AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 250000 UNION ALL SELECT n.n_nationkey, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "win_last_value_default": "SELECT o_orderkey, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l, last_value(o_orderstatus) OVER (PARTITION BY o_custkey) IS NOT NULL AS w FROM orders",
    "decimal_arithmetic": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) + 1.25 AS a, CAST(o_totalprice AS DECIMAL(12, 2)) - 0.5 AS b, CAST(o_custkey AS DECIMAL(10, 0)) * 1.5 AS c, 0.1 + 0.2 = 0.3 AS d FROM orders",
    "decimal_aggregates": "SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS s, max(CAST(o_totalprice AS DECIMAL(12, 2))) AS m FROM orders GROUP BY o_orderstatus",
    "is_general": ("SELECT c_custkey, nullif(c_nationkey, 3) IS nullif(c_nationkey, 4) AS a, c_nationkey IS NOT 5 AS b, nullif(c_nationkey, 3) IS NULL AS c FROM customer", _C.format("nullif(c_nationkey, 3) IS NOT DISTINCT FROM nullif(c_nationkey, 4) AS a, c_nationkey IS DISTINCT FROM 5 AS b, nullif(c_nationkey, 3) IS NULL AS c")),
    "fn_like_glob": (_P.format("like('%brass%', p_type) AS a, glob('Brand#[12]?', p_brand) AS b, ilike(p_name, '%A%') AS c"), _P.format("p_type ILIKE '%brass%' AS a, p_brand GLOB 'Brand#[12]?' AS b, p_name ILIKE '%A%' AS c")),
    "fn_quote_octets": (_C.format("quote(c_name) AS a, quote(c_custkey) AS b, octet_length(c_name) AS c, unistr('a\\u00e9b') AS d, quote('it''s') AS e, quote(NULL) AS f"), _C.format("'''' || c_name || '''' AS a, CAST(c_custkey AS VARCHAR) AS b, CAST(strlen(c_name) AS BIGINT) AS c, 'aéb' AS d, '''it''''s''' AS e, 'NULL' AS f")),
    "fn_row_constants": ("SELECT r_regionkey, likely(r_regionkey = 1) AS a, unlikely(r_name) AS b, likelihood(r_regionkey, 0.5) AS c, hex(zeroblob(3)) AS d, length(hex(randomblob(4))) AS e, sqlite_compileoption_used('X') AS f, total(r_regionkey) OVER () AS g FROM region", "SELECT r_regionkey, r_regionkey = 1 AS a, r_name AS b, r_regionkey AS c, '000000' AS d, CAST(8 AS BIGINT) AS e, 0 AS f, 10.0::DOUBLE AS g FROM region"),
    "map_functions": (_E.format("array_to_string(element_at(map('k', event_type), 'k'), ',') AS a, len(element_at(map('k', event_type), 'z')) AS b, array_to_string(list_sort(map_keys(map('k', event_type, 'b', 'x'))), ',') AS c, cardinality(map('k', event_type, 'b', 'x')) AS d"), _E.format("event_type AS a, CAST(0 AS BIGINT) AS b, 'b,k' AS c, CAST(2 AS BIGINT) AS d")),
    "json_build": (_E.format("json_array(event_type, event_id, NULL) AS a, json_object('k', event_id, 'v', event_type) AS b, json_quote(event_type) AS c, json(' {\"a\" : [1, 2 ] } ') AS d"), _E.format("'[\"' || event_type || '\",' || event_id || ',null]' AS a, '{\"k\":' || event_id || ',\"v\":\"' || event_type || '\"}' AS b, '\"' || event_type || '\"' AS c, '{\"a\":[1,2]}' AS d")),
    "json_lists": ("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS a, array_to_string(json_array_elements_text('[1, \"x\", true]'), '|') AS b FROM events", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS a, '1|x|true' AS b FROM events"),
    "json_from_end": (_E.format("json_extract(concat('[', CAST(event_id AS VARCHAR), ', {\"a\": [5, \"', event_type, '\"]}]'), '$[#-1].a[#-1]') AS a, json_extract_string(concat('[', CAST(event_id AS VARCHAR), ', \"', event_type, '\"]'), '$[#-1]') AS b, json_extract('[1, 2]', '$[#]') AS c, json_type('[1, \"x\"]', '$[#-1]') AS d"), _E.format("'\"' || event_type || '\"' AS a, event_type AS b, CAST(NULL AS VARCHAR) AS c, 'VARCHAR' AS d")),
    "json5_input": (_E.format("json('{a: 1, /* x */ ''b'': [+2, .5, ], // end\n}') AS a, json5_extract(concat('{k: ''', event_type, ''', }'), '$.k') AS b, json('{\"s\": \"a, // b\", }') AS c"), _E.format("'{\"a\":1,\"b\":[2,0.5]}' AS a, '\"' || event_type || '\"' AS b, '{\"s\":\"a, // b\"}' AS c")),
    "collate_rtrim": ("SELECT c_custkey FROM customer WHERE concat(c_mktsegment, '   ') COLLATE RTRIM = 'BUILDING'", "SELECT c_custkey FROM customer WHERE rtrim(c_mktsegment) = 'BUILDING'"),
    "sort_collate_nocase": ("SELECT k, v FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS k, n_nationkey AS v FROM nation) t ORDER BY k COLLATE NOCASE DESC, v LIMIT 9", "SELECT k, v FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS k, n_nationkey AS v FROM nation) t ORDER BY lower(k) DESC, v LIMIT 9"),
    "dates_modifiers": (
        _E.format("date(ts, 'start of month', '+1 month', '-1 day') AS a, datetime(ts, '+90 minutes') AS b, time(ts, '-30 seconds') AS c, strftime('%Y-%m', ts, '-1 year') AS d, date(ts, 'weekday 0') AS e, unixepoch(ts, 'start of day') AS f, datetime(event_id, 'unixepoch') AS g, julianday(ts, 'start of day') AS h, date('2024-01-31', '+1 month') AS i, datetime(2451545) AS j, date('none', '+1 day') AS k, datetime(ts, '+01:30') AS l"),
        _E.format("strftime(date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS a, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS b, strftime(ts - INTERVAL 30 SECOND, '%H:%M:%S') AS c, strftime(date_trunc('month', ts) - INTERVAL 1 YEAR, '%Y-%m') AS d, strftime(ts + to_days(CAST((7 - date_part('dow', ts)) % 7 AS INTEGER)), '%Y-%m-%d') AS e, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS f, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS g, epoch(date_trunc('day', ts)) / 86400 + 2440587.5 AS h, '2024-03-02' AS i, '2000-01-01 12:00:00' AS j, CAST(NULL AS VARCHAR) AS k, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS l"),
    ),
    "dates_timediff": (
        "SELECT event_id, timediff(date_trunc('day', ts), '2023-12-31 00:00:00') AS a, timediff('2024-03-01', '2024-01-31') AS b, timediff('2023-02-15', '2024-03-15 12:30:00') AS c, timediff(NULL, ts) AS d FROM events",
        "SELECT event_id, CASE WHEN day(ts) = 31 THEN '+0000-01-00 00:00:00.000' ELSE '+0000-00-' || lpad(CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS VARCHAR), 2, '0') || ' 00:00:00.000' END AS a, '+0000-00-30 00:00:00.000' AS b, '-0001-01-00 12:30:00.000' AS c, CAST(NULL AS VARCHAR) AS d FROM events WHERE ts < TIMESTAMP '2024-02-01' UNION ALL SELECT event_id, 'later', '', '', '' FROM events WHERE ts >= TIMESTAMP '2024-02-01'",
    ),
    "nested_struct_map": (
        "SELECT event_id, s.t AS a, s.i.u AS b, m['k'] AS c, len(l) AS d FROM (SELECT event_id, named_struct('t', event_type, 'i', named_struct('u', user_id)) AS s, map('k', event_type) AS m, array(event_id, user_id) AS l FROM events) x",
        "SELECT event_id, event_type AS a, user_id AS b, event_type AS c, CAST(2 AS BIGINT) AS d FROM events",
    ),
}

# -- Parquet ------------------------------------------------------------------------------------


def parquet_bytes(spark: SparkSession, d: str) -> DataFrame:
    """A file held in memory."""
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = load(spark, d, "nation").toPandas()  # 25 rows, a lookup table
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pandas(rows), out)
    parquet.from_bytes(spark, "nation_bytes", out.getvalue())
    return query(spark, "SELECT n_nationkey, n_name FROM nation_bytes WHERE n_regionkey < 3")


def parquet_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Structs, maps and lists written under each codec and read back."""
    events = load(spark, d, "events").select("event_id", F.struct("event_type", "user_id").alias("s"), F.create_map(F.lit("k"), "event_type").alias("m"), F.array("event_id").alias("l"))
    out = None
    for k, codec in enumerate(("zstd", "snappy", "gzip", "lz4", "uncompressed")):
        path = scratch(spark, f"codec-{codec}")
        parquet.write(events.where(F.col("event_id") % 5 == k), path, codec=codec)
        back = spark.read.parquet(path)
        out = back if out is None else out.unionByName(back)
    return out.select("event_id", F.col("s.event_type").alias("a"), F.col("s.user_id").alias("b"), F.col("m")["k"].alias("c"), F.col("l")[0].alias("e"))


def result_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a plan taken one by one, as a sink would."""
    rows = parquet.stream_rows(load(spark, d, "nation").orderBy("n_nationkey"))
    return spark.createDataFrame([(k, r.n_name) for k, r in enumerate(rows)], "n bigint, n_name string")


def row_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A predicate asked of single rows: true, false or unknown."""
    nation = load(spark, d, "nation")
    rows = nation.orderBy("n_nationkey").collect()  # a lookup table of 25 rows
    said = [(r.n_nationkey, parquet.matches(nation, "nullif(n_regionkey, 2) > 1 OR n_name LIKE 'A%'", r.asDict())) for r in rows[:6]]
    return spark.createDataFrame(said, "n_nationkey int, p boolean")


# -- SQLite ---------------------------------------------------------------------------------------


def _sqlite_file(spark: SparkSession, d: str) -> str:
    """Nations and regions (lookup tables) in a SQLite file in the shared folder."""
    path = scratch(spark, "lookup").removeprefix("file://").removeprefix("file:") + ".db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INT)")
        con.execute("CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r.n_nationkey, r.n_name, r.n_regionkey) for r in load(spark, d, "nation").collect()])
        con.executemany("INSERT INTO region VALUES (?, ?)", [(r.r_regionkey, r.r_name) for r in load(spark, d, "region").collect()])
    return path


def sqlite_scan(spark: SparkSession, d: str) -> DataFrame:
    return sqlite.read(spark, _sqlite_file(spark, d), "nation", rows_per_range=10).where("n_regionkey <> 2")


def sqlite_attach(spark: SparkSession, d: str) -> DataFrame:
    """A Parquet table joined with the tables of an attached file."""
    names = sqlite.attach(spark, _sqlite_file(spark, d), "db")
    load(spark, d, "customer").createOrReplaceTempView("customer")
    out = query(spark, "SELECT r.r_name, count(*) AS n FROM customer c JOIN db_nation n ON c.c_nationkey = n.n_nationkey JOIN db_region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
    sqlite.detach(spark, names)
    return out


def log_sqlite_join(spark: SparkSession, d: str) -> DataFrame:
    """A stream of log lines joined with a table of a SQLite file."""
    nation = sqlite.read(spark, _sqlite_file(spark, d), "nation")
    lines = _events_stream(spark, d).selectExpr("concat('level=info id=', event_id, ' nation=', user_id % 25) AS value")
    parsed = logs.parse(lines, format="logfmt").selectExpr("CAST(fields['id'] AS BIGINT) AS event_id", "CAST(fields['nation'] AS BIGINT) AS n_nationkey")
    return _drained(joins.with_table(parsed, F.broadcast(nation), "n_nationkey").select("event_id", "n_name"), "log-sqlite")


# -- logs -------------------------------------------------------------------------------------------


def _log_file(spark: SparkSession, d: str) -> str:
    path = scratch(spark, "log")
    _lines(spark, d, "concat('ts=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ' level=info id=', event_id)").select("value").write.text(path)
    return path


def log_file(spark: SparkSession, d: str) -> DataFrame:
    """A folder of log files; the format is detected."""
    return logs.read(spark, _log_file(spark, d)).selectExpr("CAST(fields['id'] AS BIGINT) AS event_id", "format", "timestamp DIV 1000000000 AS t")


def log_follow(spark: SparkSession, d: str) -> DataFrame:
    """The same folder followed as a stream."""
    return _drained(logs.follow(spark, _log_file(spark, d), format="logfmt").selectExpr("CAST(fields['id'] AS BIGINT) AS event_id", "severity"), "log-follow")


def log_rotated(spark: SparkSession, d: str) -> DataFrame:
    """A followed folder whose file is renamed and made anew: no line is lost or read twice."""
    path, checkpoint, out = scratch(spark, "rotated"), scratch(spark, "rotated-checkpoint"), scratch(spark, "rotated-out")
    lines = _lines(spark, d, "concat('level=info id=', event_id)")

    def follow() -> None:
        parsed = logs.follow(spark, path, format="logfmt").selectExpr("CAST(fields['id'] AS BIGINT) AS event_id")
        run = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()

    lines.where("event_id % 2 = 0").select("value").write.text(path)
    follow()
    fs, where = EventTable(spark, path)._fs(path)
    for k, status in enumerate(fs.listStatus(where)):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_rotated-{k}"))
    lines.where("event_id % 2 = 1").select("value").write.mode("append").text(path)
    follow()
    return spark.read.schema("event_id bigint").parquet(out)


def log_containers(spark: SparkSession, d: str) -> DataFrame:
    """Docker's and Kubernetes' wrappings of lines."""
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    inner = "concat('level=warn id=', event_id)"
    lines = _lines(spark, d, f"CASE WHEN event_id % 2 = 0 THEN to_json(named_struct('log', concat({inner}, '\\n'), 'stream', 'stdout', 'time', {stamp})) ELSE concat({stamp}, ' stdout F ', {inner}) END")
    return logs.parse(lines).selectExpr("CAST(fields['id'] AS BIGINT) AS event_id", "fields['container'] AS container", "severity", "timestamp DIV 1000000000 AS t")


def log_detect(spark: SparkSession, d: str) -> DataFrame:
    """The format that a log locks on to: most lines decide, a mixed log has none."""
    one = _lines(spark, d, "CASE WHEN event_id % 10 = 0 THEN 'plain words' ELSE concat('a=', event_id, ' b=2') END").orderBy("event_id")
    two = _lines(spark, d, "CASE event_id % 2 WHEN 0 THEN '{\"a\": 1}' ELSE 'a=1 b=2' END").orderBy("event_id")
    return spark.createDataFrame([("most", logs.detect(one)), ("mixed", logs.detect(two))], "log string, format string")


# -- streams --------------------------------------------------------------------------------------


def range_empty(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose values are all NULL: a sum of 0, no average."""
    events = load(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "none", F.col("value")))
    names = {"s": ("sum_over_time", "value"), "a": ("avg_over_time", "value"), "lo": ("min_over_time", "value"), "n": ("count_over_time", "value")}
    return windows.range_vector(events, "ts", 24 * HOUR, names, watermark=False)


def scope_default(spark: SparkSession, d: str) -> DataFrame:
    """A log query that does not say sees the last hour."""
    return windows.query(load(spark, d, "events"), "SELECT event_id FROM log", time="ts")


def scope_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What is refused over all of a log, and what is not."""
    events = load(spark, d, "events")
    said = []
    for sql in (
        "SELECT event_id FROM log SINCE ALL ORDER BY ts",
        "SELECT event_id FROM log SINCE ALL ORDER BY ts LIMIT 3",
        "SELECT DISTINCT user_id FROM log SINCE ALL",
        "SELECT a.event_id FROM log a JOIN log b ON a.user_id = b.user_id",
        "SELECT count(*) AS n FROM log SINCE ALL",
    ):
        try:
            windows.query(events, sql, time="ts")
            said.append((sql, True))
        except windows.UnboundedQuery:
            said.append((sql, False))
    return spark.createDataFrame(said, "sql string, runs boolean")


def scope_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The latest rows that fit a budget of bytes."""
    events = load(spark, d, "events").withColumn("raw", F.lpad(F.lit(""), 63, "x"))
    return windows.query(events, "SELECT count(*) AS n, max(ts) AS t FROM log SINCE 4 kb", time="ts")


def scope_report(spark: SparkSession, d: str) -> DataFrame:
    seen = windows.report(load(spark, d, "events"), "ts")
    return spark.createDataFrame([(seen["lines"], seen["first_ts"], seen["last_ts"])], "n bigint, first_ts bigint, last_ts bigint")


def standing_rows(spark: SparkSession, d: str) -> DataFrame:
    """A standing query that tells its rows each time, over the batches of a stream."""
    told: list[tuple] = []
    watch = StandingQuery(lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "rows")
    state, checkpoint = scratch(spark, "standing-state"), scratch(spark, "standing-checkpoint")
    for _ in range(2):  # started again it tells nothing twice
        run = watch.attach(_events_stream(spark, d), lambda k, rows: told.extend((r.event_type, r.n) for r in rows), lambda: 0, state, checkpointLocation=checkpoint)
        run.awaitTermination()
        watch = StandingQuery(watch.query, "rows")
    return spark.createDataFrame(told, "event_type string, n bigint").groupBy("event_type").agg(F.sum("n").alias("n"))


# -- ingested tables ----------------------------------------------------------------------------


def ingest_follow(spark: SparkSession, d: str) -> DataFrame:
    """A followed stream; its batches come again from a new process and are known."""
    where, checkpoint = scratch(spark, "followed"), scratch(spark, "followed-checkpoint")
    EventTable(spark, where).follow(_events_stream(spark, d), checkpoint).awaitTermination()
    t = EventTable(spark, where)
    t.append(load(spark, d, "events"), (checkpoint, 0))  # a replay
    return EventTable(spark, where).snapshot().select("event_id", "user_id")


def ingest_retain(spark: SparkSession, d: str) -> DataFrame:
    """Old days go from the table, and their files once nobody can be reading them."""
    events = load(spark, d, "events")
    t = EventTable(spark, scratch(spark, "retained"))
    t.append(events)
    t.compact()
    t.retain(10, "2024-01-25")
    deleted = t.vacuum()
    if not deleted or t.gone:
        raise AssertionError("no file was deleted")
    return t.snapshot().select("event_id")


# -- changes of tables --------------------------------------------------------------------------


def dml_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """INSERT OR ROLLBACK undoes a transaction, OR ABORT and OR FAIL the statement; counts of changes."""
    load(spark, d, "nation").createOrReplaceTempView("nation")
    db = dml.Database(spark)
    said: list[tuple[str, str]] = []

    def run(label: str, *sql: str) -> None:
        try:
            for s in sql:
                statements.execute(db, s)
            said.append((label, "ok"))
        except dml.ConstraintError:
            said.append((label, "refused"))
        said.append((label + " rows", str(db.tables["t"].count())))

    statements.execute(db, "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL DEFAULT 'x')")
    run("insert", "INSERT INTO t SELECT n_nationkey, n_name FROM nation")
    said.append(("last id", str(statements.execute(db, "SELECT last_insert_rowid() AS v").first().v)))
    run("abort", "INSERT OR ABORT INTO t VALUES (100, 'a'), (3, 'b')")
    run("fail", "INSERT OR FAIL INTO t VALUES (3, 'b')")
    run("rollback", "BEGIN", "DELETE FROM t WHERE id > 4", "INSERT OR ROLLBACK INTO t VALUES (1, 'b')")
    run("update", "UPDATE t SET name = upper(name) WHERE id < 7")
    said.append(("changes", str(statements.execute(db, "SELECT changes() AS v").first().v)))
    said.append(("total", str(statements.execute(db, "SELECT total_changes() AS v").first().v)))
    said.append(("check", statements.execute(db, "PRAGMA integrity_check").first()[0]))
    said += [(f"column {r.name}", f"{r.type} {r.notnull} {r.pk}") for r in statements.execute(db, "PRAGMA table_info(t)").collect()]
    said.append(("analyze", str(statements.execute(db, "ANALYZE").first().stat)))
    return spark.createDataFrame(said, "what string, said string")


def explain_statement(spark: SparkSession, d: str) -> DataFrame:
    """What EXPLAIN says of a scan with a filter: it is pushed to the file."""
    load(spark, d, "orders").createOrReplaceTempView("orders")
    lines = statements.execute(dml.Database(spark), "EXPLAIN QUERY PLAN SELECT o_orderkey FROM orders WHERE o_totalprice > 5")
    return lines.agg(F.bool_or(F.col("detail").contains("PushedFilters: [IsNotNull(o_totalprice)")).alias("pushed"), F.bool_or(F.col("detail").contains("ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>")).alias("pruned"))


def view_statement(spark: SparkSession, d: str) -> DataFrame:
    """CREATE VIEW, CREATE INDEX and DROP as statements."""
    load(spark, d, "orders").createOrReplaceTempView("orders")
    db = dml.Database(spark)
    for sql in ("CREATE VIEW big AS SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000", "CREATE INDEX i ON orders (o_custkey)", "DROP INDEX i"):
        statements.execute(db, sql)
    return statements.execute(db, "SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")


def approx_error(spark: SparkSession, d: str) -> DataFrame:
    """Whether approximate counts are within four standard deviations of the exact ones.

    Each count is an aggregation of its own: beside a DISTINCT, Spark keeps a sketch for each distinct value, not for each group.
    """
    items = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"))
    sketched = items.agg(reports.approx_distinct("l_orderkey").alias("a")).withColumnRenamed("flag", "l_returnflag")
    exact = items.agg(F.count_distinct("l_orderkey").alias("n"))
    both = sketched.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= F.col("n") * (4 * reports.SKETCH_DEVIATION) + 1).alias("close"))


def ungrouped_refused(spark: SparkSession, d: str) -> DataFrame:
    """A column that is not grouped is refused, and one that depends on the group's expression is not."""
    load(spark, d, "orders").createOrReplaceTempView("orders")
    said = []
    for sql in ("SELECT o_custkey, count(*) AS n FROM orders", "SELECT o_custkey + 1 AS k, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey"):
        try:
            query(spark, sql).schema  # noqa: B018
            said.append((sql, True))
        except Exception as e:
            if "MISSING" not in str(e) and "GROUP" not in str(e):
                raise
            said.append((sql, False))
    return spark.createDataFrame(said, "sql string, runs boolean")


def bare_limit(spark: SparkSession, d: str) -> DataFrame:
    """LIMIT without an order: any rows, so many, all of the table."""
    orders = load(spark, d, "orders")
    some = query(spark, "SELECT o_orderkey FROM orders LIMIT 17") if not orders.createOrReplaceTempView("orders") else None
    known = some.join(orders, "o_orderkey", "left_semi")
    return known.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"))


def expr_column(spark: SparkSession, d: str) -> DataFrame:
    """Expressions of the front door as columns of a DataFrame."""
    return load(spark, d, "part").select("p_partkey", expr("split_part(p_type, ' ', -1)").alias("a"), expr("p_size // 7").alias("b"), expr("p_name GLOB '*a*'").alias("c"))


_STAMP = "CAST(epoch_us(ts) // 1000000 AS BIGINT)"
_VALUES = "SELECT * FROM (VALUES {}) v({})"

CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "parquet_from_bytes": (parquet_bytes, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3"),
    "parquet_codecs": (parquet_codecs, "SELECT event_id, event_type AS a, user_id AS b, event_type AS c, event_id AS e FROM events"),
    "result_stream": (result_stream, "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n, n_name FROM nation"),
    "row_predicate": (row_predicate, "SELECT n_nationkey, nullif(n_regionkey, 2) > 1 OR n_name LIKE 'A%' AS p FROM nation ORDER BY n_nationkey LIMIT 6"),
    "sqlite_scan": (sqlite_scan, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_regionkey <> 2"),
    "sqlite_attach": (sqlite_attach, "SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    "log_sqlite_join": (log_sqlite_join, "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey"),
    "log_file": (log_file, f"SELECT event_id, 'logfmt' AS format, {_STAMP} AS t FROM events"),
    "log_follow": (log_follow, "SELECT event_id, 9 AS severity FROM events"),
    "log_rotated": (log_rotated, "SELECT event_id FROM events"),
    "log_containers": (log_containers, f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'docker' ELSE 'cri' END AS container, 13 AS severity, {_STAMP} AS t FROM events"),
    "log_detect": (log_detect, _VALUES.format("('most', 'logfmt'), ('mixed', NULL)", "log, format")),
    "range_empty_windows": (range_empty, "SELECT CAST(epoch_us(ts) // 86400000000 * 86400000000 * 1000 AS BIGINT) AS window_start, 0.0::DOUBLE AS s, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS lo, CAST(0 AS BIGINT) AS n FROM events GROUP BY 1"),
    "scope_default": (scope_default, "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"),
    "scope_refusals": (scope_refusals, _VALUES.format("('SELECT event_id FROM log SINCE ALL ORDER BY ts', false), ('SELECT event_id FROM log SINCE ALL ORDER BY ts LIMIT 3', true), ('SELECT DISTINCT user_id FROM log SINCE ALL', false), ('SELECT a.event_id FROM log a JOIN log b ON a.user_id = b.user_id', false), ('SELECT count(*) AS n FROM log SINCE ALL', true)", "sql, runs")),
    "scope_bytes": (scope_bytes, "SELECT CAST(64 AS BIGINT) AS n, max(ts) AS t FROM events"),
    "scope_report": (scope_report, "SELECT count(*) AS n, CAST(min(epoch_us(ts)) * 1000 AS BIGINT) AS first_ts, CAST(max(epoch_us(ts)) * 1000 AS BIGINT) AS last_ts FROM events"),
    "standing_rows": (standing_rows, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "ingest_follow": (ingest_follow, "SELECT event_id, user_id FROM events"),
    "ingest_retain": (ingest_retain, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'"),
    "dml_conflicts": (
        dml_conflicts,
        _VALUES.format(
            "('insert', 'ok'), ('insert rows', '25'), ('last id', '24'), ('abort', 'refused'), ('abort rows', '25'), ('fail', 'refused'), ('fail rows', '25'), ('rollback', 'refused'), ('rollback rows', '25'), ('update', 'ok'), ('update rows', '25'), ('changes', '7'), ('total', '52'), ('check', 'ok'), ('column id', 'bigint 1 1'), ('column name', 'string 1 0'), ('analyze', '25')",
            "what, said",
        ),
    ),
    "explain_statement": (explain_statement, "SELECT true AS pushed, true AS pruned"),
    "view_statement": (view_statement, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey"),
    "agg_approx_error": (approx_error, "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n, true AS close FROM lineitem GROUP BY l_returnflag"),
    "ungrouped_refused": (ungrouped_refused, _VALUES.format("('SELECT o_custkey, count(*) AS n FROM orders', false), ('SELECT o_custkey + 1 AS k, count(*) AS n FROM orders GROUP BY o_custkey', true), ('SELECT o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey', false)", "sql, runs")),
    "bare_limit": (bare_limit, "SELECT CAST(17 AS BIGINT) AS n, CAST(17 AS BIGINT) AS d"),
    "expr_column": (expr_column, "SELECT p_partkey, split_part(p_type, ' ', -1) AS a, CAST(p_size // 7 AS BIGINT) AS b, p_name GLOB '*a*' AS c FROM part"),
}
