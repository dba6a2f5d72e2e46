"""Logs, streams, changes of tables, ingested tables, SQLite files."""

import sqlite3

import pytest

from sparkloom.operators import dml
from sparkloom.sources import logs, parquet, sqlite
from sparkloom.sources.ingest import EventTable
from sparkloom.streaming import windows
from sparkloom.streaming.standing import StandingQuery

LINES = [
    "<134>Sep  9 14:23:01 webserver nginx[1234]: GET /api/health 200",
    '10.0.0.1 - alice [10/Sep/2026:08:00:05 +0200] "GET /path HTTP/1.1" 500 1834 "https://example.com" "curl/8.0"',
    '{"level":30,"time":1757404981000,"msg":"hi","service":"a","req":{"method":"GET","deep":{"a":1}},"tags":[1,2]}',
    'ts=2026-09-10T08:00:05Z level=warn msg="request \\"slow\\"" service=auth duration=184ms',
    '{"log":"<11>Jan  2 03:04:05 h app: boom\\n","stream":"stdout","time":"2026-09-10T08:00:05.5Z"}',
    "plain text",
    "2026-09-10T08:00:05.123456789Z stdout F level=error msg=x",
    "",
    "{not json",
]


def test_parse_each_format(spark):
    rows = logs.parse(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()
    assert [r.format for r in rows] == ["syslog", "clf", "json", "logfmt", "syslog", "freeform", "logfmt", "freeform", "json"]
    assert [r.severity for r in rows] == [9, None, 9, 13, 17, None, 17, None, None]
    assert rows[0].fields == {"host": "webserver", "service": "nginx", "pid": "1234"} and rows[0].facility == "local0"
    assert rows[1].fields["status"] == "500" and rows[1].timestamp == 1789020005 * 10**9
    assert rows[2].fields == {"service": "a", "req.method": "GET", "tags": "[1,2]"}
    assert rows[3].message == 'request "slow"' and rows[3].fields["duration"] == "184ms"
    assert rows[4].fields["container"] == "docker" and rows[4].message == "boom"
    assert rows[6].timestamp == 1789027205123456789
    assert rows[5].message == "plain text"


def test_detect_locks_on(spark):
    mixed = spark.createDataFrame([(x,) for x in LINES], "value string")
    assert logs.detect(mixed) is None
    assert logs.detect(spark.createDataFrame([("a=1 b=2",)] * 9 + [("x",)], "value string")) == "logfmt"
    assert logs.detect(spark.createDataFrame([], "value string")) is None


def test_follow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LINES))
    q = logs.follow(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("followed").count() == len(LINES)


def _log(spark):
    rows = [(s * 10**9, float(s)) for s in (1, 2, 3, 4, 9, 11, 12, 13)]
    return spark.createDataFrame(rows, "timestamp bigint, v double")


def test_range_vector(spark):
    got = windows.range_vector(_log(spark), "timestamp", 10, {"n": ("count_over_time", "*"), "s": ("sum_over_time", "v")})
    assert sorted(map(tuple, got.collect())) == [(0, 5, 19.0), (10 * 10**9, 3, 36.0)]
    later = _log(spark).union(spark.createDataFrame([(35 * 10**9, 1.0)], "timestamp bigint, v double"))
    got = windows.query(later, "SELECT rate(*) RANGE 10 s FROM log")
    assert sorted(map(tuple, got.collect())) == [(30 * 10**9, 0.1)]
    assert windows.late(later, "timestamp", 10).count() == 8


def test_scope_and_report(spark):
    assert windows.query(_log(spark), "SELECT count(*) AS n FROM log SINCE 3 s").first().n == 3
    assert windows.scope(_log(spark), "timestamp", "2 lines").count() == 2
    assert windows.report(_log(spark), "timestamp") == {"lines": 8, "first_ts": 10**9, "last_ts": 13 * 10**9}
    sized = _log(spark).selectExpr("timestamp", "'1234' AS t")
    assert windows.last_bytes(sized, "timestamp", "t", 14).count() == 2


def test_standing(spark):
    one = spark.createDataFrame([(5.0,)], "v double")
    q = StandingQuery(lambda df: df, "threshold", ">", 3, hold_ns=5)
    assert [bool(q.poll(one, t)) for t in (0, 4, 5, 9)] == [False, False, True, False]
    q.poll(spark.createDataFrame([(1.0,)], "v double"), 10)
    assert [bool(q.poll(one, t)) for t in (11, 16)] == [False, True]
    c = StandingQuery(lambda df: df, "on_change")
    assert [len(c.poll(one)) for _ in range(2)] == [1, 0]


def test_standing_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(str(tmp_path / "in"))
    told = []
    stream = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
    StandingQuery(lambda df: df.groupBy().sum("v"), "on_change").attach(stream, lambda n, r: told.append(r[0][0]), lambda: 0, checkpointLocation=str(tmp_path / "c")).awaitTermination()
    assert sum(told) == 3


def test_database(spark):
    db = dml.Database(spark)
    db.create("acc", "id int, name string, n int", dml.Constraints(not_null=["id"], unique=[["id"]], check=["n >= 0"], default={"n": "0"}))
    rows = lambda *r: spark.createDataFrame(list(r), "id int, name string, n int")
    db.insert("acc", rows((1, "a", 5), (2, "b", None)))
    assert sorted(map(tuple, db.sql("SELECT * FROM acc").collect())) == [(1, "a", 5), (2, "b", 0)]
    for bad in (rows((1, "x", 1)), rows((None, "x", 1)), rows((9, "x", -1))):
        with pytest.raises(dml.ConstraintError):
            db.insert("acc", bad)
    db.begin()
    db.delete("acc", "id = 1")
    db.insert("acc", rows((2, "z", 7)), "replace")
    assert sorted(map(tuple, db.sql("SELECT * FROM acc").collect())) == [(2, "z", 7)]
    db.rollback()
    assert db.sql("SELECT count(*) AS c FROM acc").first().c == 2
    db.insert("acc", rows((2, "q", 1), (3, "c", 1)), "ignore")
    db.upsert("acc", rows((3, "d", 4), (4, "e", 4)), ["id"], {"n": "t.n + excluded.n"})
    db.update("acc", {"name": "upper(name)"}, "id > 2")
    assert sorted(map(tuple, db.sql("SELECT * FROM acc").collect())) == [(1, "a", 5), (2, "b", 0), (3, "C", 5), (4, "E", 4)]
    db.drop("acc")


def test_ingest(spark, tmp_path):
    t = EventTable(spark, f"file://{tmp_path}/t", stats=["ts", "k"])
    frame = lambda rows: spark.createDataFrame(rows, "ts string, k int").selectExpr("CAST(ts AS TIMESTAMP_NTZ) AS ts", "k")
    t.append(frame([("2024-01-01 00:10:00", 1), ("2024-01-01 05:10:00", 2), (None, 3)]))
    t.append(frame([("2024-01-02 00:10:00", 4)]))
    assert len(t.files) == 4 and t.snapshot().count() == 4
    other = EventTable(spark, f"file://{tmp_path}/t", stats=["ts", "k"])
    t.compact()
    assert len(t.files) == 3
    with pytest.raises(RuntimeError):
        other.append(frame([("2024-01-03 00:00:00", 9)]))
    other.refresh()
    assert len(other.candidates({"k": (4, None)})) == 1
    assert [r.k for r in other.snapshot(bounds={"k": (4, None)}).collect()] == [4]
    other.append(spark.createDataFrame([("2024-01-05", 1.5, "m")], "ts string, k double, more string").selectExpr("CAST(ts AS TIMESTAMP_NTZ) AS ts", "k", "more"))
    assert dict(other.snapshot().dtypes)["k"] == "double" and other.snapshot().where("more IS NULL").count() == 4
    assert other.retain(2, "2024-01-04") == 1


def test_sqlite_join(spark, tmp_path):
    with sqlite3.connect(tmp_path / "l.db") as con:
        con.execute("CREATE TABLE labels(id INTEGER PRIMARY KEY, label TEXT, w REAL)")
        con.executemany("INSERT INTO labels VALUES (?, ?, ?)", [(1, "x", 1.5), (2, None, 2), (7, "z", None)])
    assert sqlite.attach(spark, str(tmp_path / "l.db"), "aux") == ["aux_labels"]
    got = spark.sql("SELECT n_nationkey, label, w FROM aux_labels JOIN VALUES (1), (2), (3) AS n(n_nationkey) ON id = n_nationkey").collect()
    assert sorted(map(tuple, got)) == [(1, "x", 1.5), (2, None, 2.0)]
    sqlite.detach(spark, ["aux_labels"])


def test_parquet(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 7 AS k")
    parquet.write(df, str(tmp_path / "p.parquet"), sort=["id"], files=3)
    back = parquet.open_table(spark, str(tmp_path / "p.parquet"))
    assert back.count() == 100 and spark.sql("SELECT count(*) AS n FROM p").first().n == 100
    assert len(list(parquet.stream_rows(back))) == 100
    assert parquet.matches(back, "id > 3 AND k < 2", {"id": 4, "k": 1}) is True
    assert parquet.matches(back, "id > 3", {"id": None, "k": 1}) is None


def test_statements(spark):
    from sparkloom.operators.statements import execute

    db = dml.Database(spark)
    run = lambda s: execute(db, s)
    run("CREATE TABLE acc2 (id INTEGER PRIMARY KEY, name VARCHAR(10) UNIQUE, n INT NOT NULL DEFAULT 3, CHECK (n < 100))")
    run("INSERT INTO acc2 (id, name) VALUES (1, 'a'), (2, 'b')")
    with pytest.raises(dml.ConstraintError):
        run("INSERT INTO acc2 VALUES (3, 'a', 1)")
    run("UPDATE acc2 SET (name, n) = ('z', n * 2) WHERE id = 2")
    run("CREATE VIEW big AS SELECT id FROM acc2 WHERE n > 3")
    run("CREATE INDEX i ON acc2 (n)")
    assert [r.id for r in run("SELECT id FROM big").collect()] == [2]
    run("INSERT INTO acc2 VALUES (2, 'y', 1) ON CONFLICT DO NOTHING")
    assert sorted(map(tuple, run("SELECT * FROM acc2").collect())) == [(1, "a", 3), (2, "z", 6)]
    run("DROP TABLE acc2")
    with pytest.raises(ValueError):
        run("DROP TABLE acc2")


def test_json_editing():
    from sparkloom.functions.json_edit import edit, error_position

    assert edit("set", '{"a":[1,2]}', "$.a[#]", "3") == '{"a":[1,2,3]}'
    assert edit("set", '{"a":1}', "$.b.c", '"x"') == '{"a":1,"b":{"c":"x"}}'
    assert edit("insert", '{"a":1}', "$.a", "2") == '{"a":1}' and edit("replace", '{"a":1}', "$.b", "2") == '{"a":1}'
    assert edit("remove", '[1,2,3]', "$[#-1]", None) == "[1,2]" and edit("element", '{"k":[5]}', '$."k"[0]', None) == "5"
    assert edit("patch", '{"a":{"b":1,"c":2}}', '{"a":{"b":null}}', None) == '{"a":{"c":2}}'
    assert edit("set", "{", "$.a", "1") is None and edit("set", None, "$.a", "1") is None
    assert error_position("[1]") == 0 and error_position("[1") == 3 and error_position(None) is None


def test_rollups(spark):
    from sparkloom.streaming import rollups

    rows, kept = rollups.evict(_log(spark), None, "timestamp", 10, ["v"], 15 * 10**9)
    assert rows.count() == 3
    rows, kept = rollups.evict(rows, kept, "timestamp", 10, ["v"], 25 * 10**9)
    assert tuple(rollups.totals(rows, kept, "timestamp", 10, ["v"]).first()) == (8, 55.0, 1.0, 13.0)


def test_whole_tables_are_ingested_and_polled(spark, sf, monkeypatch):
    """Appending, compacting, widening and pruning see all events, standing queries all days."""
    from sparkloom.plans import moving

    events = spark.read.parquet(f"{sf}/events.parquet")
    given = []

    class Counted:
        files = [None]

        def __init__(self, *_, **__):
            given.clear()

        append = staticmethod(lambda df: given.append(df.count()))
        compact = staticmethod(lambda: 0)
        candidates = staticmethod(lambda bounds: [])
        snapshot = staticmethod(lambda **_: events.selectExpr("*", "user_id AS v", "user_id AS more"))

    monkeypatch.setattr(moving, "EventTable", Counted)
    n = events.count()
    for query, times in ((moving.ingest_append_compact, 1), (moving.schema_widen, 2), (moving.manifest_prune, 1)):
        query(spark, sf)
        assert sum(given) == times * n, query.__name__
    days = []
    monkeypatch.setattr(StandingQuery, "poll", lambda self, df, now_ns=0: days.append(df.count()) or [])
    for query in (moving.standing_on_change, moving.standing_threshold):
        days.clear()
        query(spark, sf)
        assert len(days) == events.selectExpr("day(ts)").distinct().count() and days[-1] == n


def test_standing_is_told_once_over_restarts(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "v int").write.parquet(str(tmp_path / "in"))
    told = []

    def run(checkpoint: str) -> None:
        stream = spark.readStream.schema("v int").parquet(str(tmp_path / "in"))
        watch = StandingQuery(lambda df: df.groupBy().sum("v"), "rows")
        watch.attach(stream, lambda n, r: told.append(r[0][0]), lambda: 0, str(tmp_path / "state"), checkpointLocation=str(tmp_path / checkpoint)).awaitTermination()

    run("a")
    run("b")  # its checkpoint is lost, so batch 0 comes again
    assert told == [3]
    with pytest.raises(ValueError):
        StandingQuery(lambda df: df, "rows").poll(spark.range(100_001))


def test_ingest_knows_replayed_batches(spark, tmp_path):
    where = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "id long, ts string").selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts")
    EventTable(spark, where).append(rows, ("w", 4))
    for batch in (("w", 4), ("w", 3), ("v", 0), ("w", 5)):
        EventTable(spark, where).append(rows, batch)
    t = EventTable(spark, where)
    assert t.snapshot().count() == 3 and t.batches == {"w": 5, "v": 0}
    t.compact()
    old = [path for path, _ in t.gone]
    assert len(old) == 3 and t.vacuum(grace_ns=10**18) == 0 and len(t.gone) == 3
    assert t.vacuum() == 3 and t.gone == [] and EventTable(spark, where).snapshot().count() == 3
    assert t.batches == {"w": 5, "v": 0}


def test_names_that_come_twice(spark):
    lines = ['{"time":null,"ts":1757404981,"msg":"a","message":"b","Host":"h","server":"s","x":null}', "msg=a message=b x=1 x=2", '{"a":{"b":1},"a.b":2}', "{}"]
    rows = logs.parse(spark.createDataFrame([(x, k) for k, x in enumerate(lines)], "value string, k int")).collect()
    assert rows[0].message == "a" and rows[0].timestamp == 1757404981 * 10**9 and rows[0].fields == {"host": "h", "x": None}
    assert rows[1].message == "a" and rows[1].fields == {"x": "1"}
    assert rows[2].fields == {"a.b": "1"} and rows[3].fields == {} and rows[3].message is None


def test_statements_that_fail(spark):
    from sparkloom.operators import statements

    db = dml.Database(spark)
    run = lambda sql: statements.execute(db, sql)
    run("CREATE TABLE s (id INTEGER PRIMARY KEY, v TEXT CHECK (length(v) < 4))")
    run("INSERT INTO s VALUES (1, 'a')")
    for sql in ("INSERT INTO s VALUES (1, 'b')", "INSERT OR FAIL INTO s VALUES (2, 'long')", "INSERT INTO s VALUES (NULL, 'b')", "UPDATE s SET v = 'long'"):
        with pytest.raises(dml.ConstraintError):
            run(sql)
    run("BEGIN")
    run("DELETE FROM s")
    with pytest.raises(dml.ConstraintError):
        run("INSERT OR ROLLBACK INTO s VALUES (3, 'long')")
    assert run("SELECT * FROM s").count() == 1 and run("SELECT changes() AS c, last_insert_rowid() AS r").first() == (1, 1)
    assert [r.name for r in run("PRAGMA table_list").collect()] == ["s"] and run("PRAGMA journal_mode").count() == 1 and run("PRAGMA unknown") is None
    db.tables["s"] = spark.createDataFrame([(1, "a"), (1, "long")], "id long, v string")
    assert "CHECK" in run("PRAGMA integrity_check").first()[0]
    assert run("EXPLAIN SELECT 1 AS a").count() > 0


def test_scopes(spark):
    log = spark.createDataFrame([(k * 600 * 10**9, f"line {k}") for k in range(20)], "timestamp long, raw string")
    count = lambda sql, **o: windows.query(log, sql, **o).collect()[0][0]
    assert count("SELECT count(*) AS n FROM log") == 7  # the last hour
    assert count("SELECT count(*) AS n FROM log SINCE ALL") == 20 and count("SELECT count(*) AS n FROM log", default=None) == 20
    assert count("SELECT count(*) AS n FROM log SINCE 30 m UNTIL 10 m") == 3 and count("SELECT count(*) AS n FROM log SINCE 16 b") == 2
    for sql in ("SELECT raw FROM log SINCE ALL ORDER BY raw", "SELECT DISTINCT raw FROM log SINCE ALL", "SELECT 1 FROM log JOIN log AS b"):
        with pytest.raises(windows.UnboundedQuery):
            windows.query(log, sql)
    assert len(windows.query(log, "SELECT raw FROM log WHERE raw <> 'a JOIN b' ORDER BY raw").collect()) == 7
