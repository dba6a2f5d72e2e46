"""Queries over live data, logs, changing and ingested tables, with their SQL."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import dml, reports, statements
from sparkloom.session import load
from sparkloom.sources import logs, parquet
from sparkloom.sources.ingest import EventTable
from sparkloom.sql import query
from sparkloom.streaming import joins, rollups, windows
from sparkloom.streaming.standing import StandingQuery

HOUR = 3600


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for tables that a query writes: the shared one; a local session without one has the temp folder."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        directory = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = directory.get() if directory.isDefined() else None
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        held = "file://" + os.path.join(tempfile.gettempdir(), "sparkloom-tables")
    return f"{held.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# -- views, parameters, collations, sinks ---------------------------------------------


def view(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "orders").createOrReplaceTempView("orders")
    query(spark, "SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000").createOrReplaceTempView("large_orders")
    return query(spark, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM large_orders GROUP BY o_custkey")


def bound_parameters(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return query(spark, "SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderstatus = $state", {"low": 200000.0, "state": "F"})


def collate_nocase(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "customer").createOrReplaceTempView("customer")
    return query(spark, "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'")


def parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """Written in order of a key and read back with a bound that prunes row groups."""
    path = scratch(spark, "sorted")
    parquet.write(load(spark, d, "orders"), path, sort=["o_totalprice"])
    return spark.read.parquet(path).where("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


# -- range vectors ---------------------------------------------------------------

_WINDOW = "CAST(epoch_us(ts) // 3600000000 * 3600000000 * 1000 AS BIGINT)"
_LATEST = "(SELECT max(epoch_us(ts)) * 1000 FROM events)"
_OPEN = f"{_WINDOW} + 3600000000000 > {_LATEST} - 3600000000000"


def range_count(spark: SparkSession, d: str) -> DataFrame:
    return windows.range_vector(load(spark, d, "events"), "ts", HOUR, {"n": ("count_over_time", "*")})


def range_rate(spark: SparkSession, d: str) -> DataFrame:
    out = windows.range_vector(load(spark, d, "events"), "ts", HOUR, {"r": ("rate", "*")}, watermark=False)
    return out.select("window_start", F.round("r", 9).alias("r"))


def range_values(spark: SparkSession, d: str) -> DataFrame:
    names = {"s": ("sum_over_time", "value"), "a": ("avg_over_time", "value"), "lo": ("min_over_time", "value"), "hi": ("max_over_time", "value")}
    out = windows.range_vector(load(spark, d, "events"), "ts", HOUR, names, watermark=False)
    return out.select("window_start", F.round("s", 4).alias("s"), F.round("a", 6).alias("a"), "lo", "hi")


def watermark_on_time(spark: SparkSession, d: str) -> DataFrame:
    return windows.on_time(load(spark, d, "events"), "ts", HOUR).select("event_id", "window_start")


def watermark_late(spark: SparkSession, d: str) -> DataFrame:
    return windows.late(load(spark, d, "events"), "ts", HOUR).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))


def scope_since_until(spark: SparkSession, d: str) -> DataFrame:
    return windows.scope(load(spark, d, "events"), "ts", "10 d", "2 d").select("event_id")


def scope_last_lines(spark: SparkSession, d: str) -> DataFrame:
    return windows.scope(load(spark, d, "events"), "ts", "25 lines").select("ts")


def stream_sql(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").withColumn("severity", F.when(F.col("event_type") == "error", 17).otherwise(9))
    return windows.query(log, "SELECT count_over_time(*) RANGE 1 h AS n FROM log WHERE severity >= 'WARN' SINCE 3 d", time="ts")


# -- Structured Streaming ------------------------------------------------------------


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream of what there is now gives, written to the shared folder."""
    spark = stream.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    run.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    # a stream reads folders: a table of one file is named by a pattern
    one = next(iter(spark.read.parquet(path).inputFiles()), "").endswith("/events.parquet")
    return spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events*" if one else path)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows of a streamed table, in append mode."""
    out = windows.range_vector_stream(_events_stream(spark, d), "ts", HOUR, {"n": ("count_over_time", "*")})
    return _drained(out, "stream-windows")


def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    """A stream of events with a lookup table."""
    kinds = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "event_type string, weight int")
    return _drained(joins.with_table(_events_stream(spark, d), F.broadcast(kinds), "event_type").select("event_id", "weight"), "stream-static")


def _views_and_purchases(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = events.where("event_type = 'view'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").cast("timestamp").alias("ta"))
    b = events.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").cast("timestamp").alias("tb"))
    return a, b


def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Two streams, matched within six hours."""
    a, _ = _views_and_purchases(_events_stream(spark, d))
    _, b = _views_and_purchases(_events_stream(spark, d))
    return _drained(joins.between_streams(a, b, F.col("ua") == F.col("ub"), "ta", "tb", 6 * HOUR, 31 * 24 * HOUR).select("a", "b"), "stream-stream")


def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """The same over tables."""
    a, b = _views_and_purchases(load(spark, d, "events"))
    return joins.between_streams(a, b, F.col("ua") == F.col("ub"), "ta", "tb", 6 * HOUR).select("a", "b")


def _day_by_day(events: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """The number of each day of the table, from 1, and the events up to its end."""
    first, n = events.agg(F.min(F.to_date("ts")), F.datediff(F.max("ts"), F.min("ts")) + 1).first()
    for day in range(1, (n or 0) + 1):
        yield day, events.where(F.to_date("ts") < F.date_add(F.lit(first), day))


def standing_on_change(spark: SparkSession, d: str) -> DataFrame:
    """How often a standing count tells something new while the days come in."""
    events = load(spark, d, "events")
    watch = StandingQuery(lambda df: df.where("event_type = 'error'").agg(F.count(F.lit(1)).alias("n")), "on_change")
    told = [(day, r[0].n) for day, seen in _day_by_day(events) if (r := watch.poll(seen))]
    return spark.createDataFrame(told, "day int, n bigint")


def standing_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The count of errors on the day on which it has been above three for two days."""
    events = load(spark, d, "events")
    count = F.count(F.lit(1))
    watch = StandingQuery(lambda df: df.where("event_type = 'error'").agg(count.alias("n")), "threshold", ">", 3, hold_ns=2)
    told = [(day, r[0].n) for day, seen in _day_by_day(events) if (r := watch.poll(seen, now_ns=day))]
    return spark.createDataFrame(told, "day int, n bigint")


# -- logs: lines made of events, parsed back ------------------------------------------


def _lines(spark: SparkSession, d: str, template: str) -> DataFrame:
    return load(spark, d, "events").selectExpr("event_id", f"{template} AS value")


def log_syslog(spark: SparkSession, d: str) -> DataFrame:
    stamp = "date_format(ts, 'MMM'), lpad(CAST(day(ts) AS STRING), 3, ' '), date_format(ts, ' HH:mm:ss')"
    lines = _lines(spark, d, f"concat('<', 8 * 16 + user_id % 8, '>', {stamp}, ' host', user_id % 3, ' ', event_type, '[', event_id, ']: took ', user_id, ' ms')")
    return logs.parse(lines, format="syslog").selectExpr("CAST(fields['pid'] AS BIGINT) AS event_id", "severity", "facility", "fields['host'] AS host", "fields['service'] AS service", "message", "timestamp DIV 1000000000 AS t")


def log_clf(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "concat('10.0.0.', user_id % 200, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '/', event_id, ' HTTP/1.1\" ', 200 + user_id % 5 * 100, ' ', event_id, ' \"-\" \"curl/8.0\"')")
    return logs.parse(lines, format="clf").selectExpr("CAST(fields['bytes'] AS BIGINT) AS event_id", "fields['host'] AS host", "fields['path'] AS path", "CAST(fields['status'] AS BIGINT) AS status", "fields['user_agent'] AS agent", "timestamp DIV 1000000000 AS t")


def log_jsonl(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "to_json(named_struct('level', 10 * (user_id % 6 + 1), 'time', unix_millis(CAST(ts AS TIMESTAMP)), 'msg', event_type, 'app', 'shop', 'req', named_struct('id', event_id, 'url', '/x')))")
    return logs.parse(lines, format="json").selectExpr("CAST(fields['req.id'] AS BIGINT) AS event_id", "severity", "severity_text", "message", "fields['service'] AS service", "fields['req.url'] AS url", "timestamp DIV 1000000 AS t")


def log_logfmt(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d, "concat('ts=', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), ' level=', CASE WHEN event_type = 'error' THEN 'err' ELSE 'info' END, ' msg=\"a ', event_type, '\" id=', event_id, ' duration=', user_id, 'ms')")
    return logs.parse(lines, format="logfmt").selectExpr("CAST(fields['id'] AS BIGINT) AS event_id", "severity", "message", "fields['duration'] AS duration", "timestamp DIV 1000000000 AS t")


def format_detect(spark: SparkSession, d: str) -> DataFrame:
    """The format of each line of a mixed log."""
    mixed = _lines(spark, d, "CASE event_id % 4 WHEN 0 THEN '{\"a\": 1}' WHEN 1 THEN '<13>Jan  1 00:00:00 h app: x' WHEN 2 THEN 'a=1 b=2' ELSE 'plain' END")
    return mixed.groupBy(logs.format_of(F.col("value")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


# -- changes of tables -----------------------------------------------------------------


def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    rows = nation.where("n_nationkey < 3").selectExpr("n_nationkey + 100 AS n_nationkey", "n_name", "n_regionkey")
    return dml.insert(nation, rows)


def dml_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(load(spark, d, "nation"), {"n_name": "lower(n_name)", "n_regionkey": "n_regionkey + 1"}, "n_regionkey = 2")


def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete(load(spark, d, "nation"), "nullif(n_regionkey, 3) > 1")


def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    rows = nation.where("n_nationkey >= 20").selectExpr("n_nationkey + 3 AS n_nationkey", "concat('new ', n_name) AS n_name", "n_regionkey")
    return dml.upsert(nation, rows, ["n_nationkey"], {"n_name": "excluded.n_name"})


def dml_replace(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    return dml.replace(nation, nation.where("n_nationkey >= 20").selectExpr("n_nationkey + 3 AS n_nationkey", "'r' AS n_name", "n_regionkey"), ["n_nationkey"])


def dml_script(spark: SparkSession, d: str) -> DataFrame:
    """A session of DDL, DML and transactions as SQL text."""
    load(spark, d, "nation").createOrReplaceTempView("nation")
    db = dml.Database(spark)
    for statement in (
        "CREATE TABLE IF NOT EXISTS n (id INTEGER PRIMARY KEY, name TEXT NOT NULL, r INT DEFAULT 7, CHECK (id >= 0))",
        "INSERT INTO n (id, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10",
        "INSERT OR IGNORE INTO n VALUES (3, 'ignored', 1), (50, 'fifty', 5)",
        "INSERT OR REPLACE INTO n VALUES (4, 'four', 4)",
        "INSERT INTO n VALUES (5, 'five', 2), (60, 'sixty', 6) ON CONFLICT (id) DO UPDATE SET name = excluded.name, r = r + excluded.r",
        "UPDATE n SET name = lower(name), r = r + 1 WHERE id BETWEEN 1 AND 2",
        "BEGIN", "DELETE FROM n", "ROLLBACK",
        "DELETE FROM n WHERE id = 9",
    ):
        statements.execute(db, statement)
    return statements.execute(db, "SELECT id, name, r FROM n")


def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    """All-time totals after the older half of the rows went into a rollup."""
    events = load(spark, d, "events")
    rows, kept = rollups.evict(events, None, "ts", HOUR, ["value"], 1705276800 * 10**9)
    out = rollups.totals(rows, kept, "ts", HOUR, ["value"])
    return out.select("n", F.round("value_sum", 4).alias("s"), F.col("value_min").alias("lo"), F.col("value_max").alias("hi"))


# -- ingested tables -------------------------------------------------------------------


def ingest_append_compact(spark: SparkSession, d: str) -> DataFrame:
    """Two appends and a compaction keep all rows."""
    events = load(spark, d, "events")
    t = EventTable(spark, scratch(spark, "events"), stats=["ts", "user_id"])
    t.append(events.where("event_id % 2 = 0"))
    t.append(events.where("event_id % 2 = 1"))
    t.compact()
    return t.snapshot().select("event_id", "event_type")


def schema_widen(spark: SparkSession, d: str) -> DataFrame:
    """An int column becomes double, a new one is NULL in older files."""
    events = load(spark, d, "events")
    t = EventTable(spark, scratch(spark, "events"))
    t.append(events.selectExpr("event_id", "ts", "CAST(user_id AS INT) AS v"))
    t.append(events.selectExpr("event_id + 1000000 AS event_id", "ts", "value AS v", "event_type AS more"))
    return t.snapshot().select("event_id", "v", "more")


def manifest_prune(spark: SparkSession, d: str) -> DataFrame:
    """A bound on the statistics columns reads the day's files only."""
    events = load(spark, d, "events")
    t = EventTable(spark, scratch(spark, "events"), stats=["ts"])
    t.append(events)
    t.compact()
    bounds = {"ts": ("2024-01-02 00:00:00", "2024-01-02 23:59:59.999999")}
    if len(t.candidates(bounds)) >= len(t.files):
        raise AssertionError("no file was pruned")
    return t.snapshot(bounds=bounds).select("event_id")


def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(reports.approx_distinct("l_orderkey").alias("n"))


_NEAR = "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR"
#: The number of each day, from 1, and the errors up to its end.
_BY_DAY = """(SELECT CAST(d AS INTEGER) AS day, (SELECT count(*) FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) < f + CAST(d AS INTEGER)) AS n
    FROM (SELECT CAST(min(ts) AS DATE) AS f, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS m FROM events) r, range(1, 400) t(d) WHERE d <= m)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "view": (view, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey"),
    "bound_parameters": (bound_parameters, "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'"),
    "collate_nocase": (collate_nocase, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "parquet_sink": (parquet_sink, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000"),
    "range_count_over_time": (range_count, f"SELECT {_WINDOW} AS window_start, count(*) AS n FROM events WHERE {_OPEN} GROUP BY 1"),
    "range_rate": (range_rate, f"SELECT {_WINDOW} AS window_start, round(count(*) / 3600.0::DOUBLE, 9) AS r FROM events GROUP BY 1"),
    "range_sum_avg_min_max": (range_values, f"SELECT {_WINDOW} AS window_start, round(coalesce(sum(value), 0), 4) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1"),
    "watermark_on_time": (watermark_on_time, f"SELECT event_id, {_WINDOW} AS window_start FROM events WHERE {_OPEN}"),
    "watermark_late_rows": (watermark_late, f"SELECT {_WINDOW} AS window_start, count(*) AS n FROM events WHERE NOT ({_OPEN}) GROUP BY 1"),
    "scope_since_until": (scope_since_until, "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"),
    "scope_last_lines": (scope_last_lines, "SELECT ts FROM events ORDER BY ts DESC LIMIT 25"),
    "stream_sql": (stream_sql, f"SELECT w AS window_start, count(*) AS n FROM (SELECT {_WINDOW} AS w FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAY) t WHERE w + 3600000000000 > (SELECT max(epoch_us(ts)) * 1000 FROM events WHERE event_type = 'error') - 3600000000000 GROUP BY 1"),
    # a window comes out once the watermark, one window behind the latest event, has passed its end
    "stream_windows": (stream_windows, f"SELECT {_WINDOW} AS window_start, count(*) AS n FROM events WHERE NOT ({_OPEN}) GROUP BY 1"),
    "stream_static_join": (stream_static_join, "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS INTEGER) AS weight FROM events WHERE event_type IN ('click', 'view', 'purchase')"),
    "stream_stream_join": (stream_stream_join, _NEAR),
    "interval_join": (interval_join, _NEAR),
    "standing_onchange": (standing_on_change, f"SELECT day, n FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM {_BY_DAY}) x WHERE n IS DISTINCT FROM before"),
    "standing_threshold": (standing_threshold, f"SELECT day, n FROM {_BY_DAY} y WHERE day = (SELECT min(day) + 2 FROM {_BY_DAY} z WHERE n > 3)"),
    "log_parse_syslog": (log_syslog, "SELECT event_id, CAST([21, 21, 21, 17, 13, 9, 9, 5][user_id % 8 + 1] AS INTEGER) AS severity, 'local0' AS facility, 'host' || (user_id % 3) AS host, event_type AS service, 'took ' || user_id || ' ms' AS message, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events"),
    "log_parse_clf": (log_clf, "SELECT event_id, '10.0.0.' || (user_id % 200) AS host, '/' || event_type || '/' || event_id AS path, 200 + user_id % 5 * 100 AS status, 'curl/8.0' AS agent, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events"),
    "log_parse_jsonl": (log_jsonl, "SELECT event_id, CAST([1, 5, 9, 13, 17, 21][user_id % 6 + 1] AS INTEGER) AS severity, ['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'][user_id % 6 + 1] AS severity_text, event_type AS message, 'shop' AS service, '/x' AS url, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t FROM events"),
    "log_parse_logfmt": (log_logfmt, "SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS INTEGER) AS severity, 'a ' || event_type AS message, user_id || 'ms' AS duration, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t FROM events"),
    "format_detect": (format_detect, "SELECT ['json', 'syslog', 'logfmt', 'freeform'][event_id % 4 + 1] AS format, count(*) AS n FROM events GROUP BY 1"),
    "dml_insert_select": (dml_insert, "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_nationkey < 3"),
    "dml_update": (dml_update, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS n_name, CAST(n_regionkey + CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_regionkey FROM nation"),
    "dml_delete": (dml_delete, "SELECT * FROM nation WHERE NOT coalesce(nullif(n_regionkey, 3) > 1, false)"),
    "dml_upsert": (dml_upsert, "SELECT t.n_nationkey, coalesce('new ' || x.n_name, t.n_name) AS n_name, t.n_regionkey FROM nation t LEFT JOIN (SELECT n_nationkey + 3 AS k, n_name FROM nation WHERE n_nationkey >= 20) x ON t.n_nationkey = x.k UNION ALL SELECT n_nationkey + 3, 'new ' || n_name, n_regionkey FROM nation WHERE n_nationkey >= 20 AND n_nationkey + 3 NOT IN (SELECT n_nationkey FROM nation)"),
    "dml_replace": (dml_replace, "SELECT * FROM nation WHERE n_nationkey < 23 UNION ALL SELECT n_nationkey + 3, 'r', n_regionkey FROM nation WHERE n_nationkey >= 20"),
    "dml_script": (dml_script, "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey IN (1, 2) THEN lower(n_name) WHEN n_nationkey = 4 THEN 'four' WHEN n_nationkey = 5 THEN 'five' ELSE n_name END AS name, CAST(CASE WHEN n_nationkey IN (1, 2) THEN 8 WHEN n_nationkey = 4 THEN 4 WHEN n_nationkey = 5 THEN 9 ELSE 7 END AS BIGINT) AS r FROM nation WHERE n_nationkey < 9 UNION ALL VALUES (50, 'fifty', 5), (60, 'sixty', 6)"),
    "rollup_totals": (rollup_totals, "SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi FROM events"),
    "ingest_append_compact": (ingest_append_compact, "SELECT event_id, event_type FROM events"),
    "schema_widen": (schema_widen, "SELECT event_id, CAST(user_id AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS more FROM events UNION ALL SELECT event_id + 1000000, value, event_type FROM events"),
    "manifest_prune": (manifest_prune, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'"),
    "agg_approx_distinct": (approx_distinct, None),
}
