"""Standing queries: a query that is asked again as data comes in, and tells what is new."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession

#: Rows of a result at most.
MOST_ROWS = 100_000

_OPERATORS: dict[str, Callable] = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq, "<>": operator.ne}


class StandingQuery:
    """Emits rows (``rows``), changed results (``on_change``) or crossings (``threshold``).

    ``query`` maps the data to a result of at most ``MOST_ROWS`` rows (more are refused);
    only that reaches the driver.  For
    thresholds the result is one number; it must hold for ``hold_ns`` before it fires,
    and fires once until it has been false again.
    """

    def __init__(self, query: Callable[[DataFrame], DataFrame], mode: str = "rows", op: str = ">", value: float = 0.0, hold_ns: int = 0):
        if mode not in ("rows", "on_change", "threshold"):
            raise ValueError(f"unknown mode {mode}")
        self.query, self.mode, self.op, self.value, self.hold_ns = query, mode, _OPERATORS[op], value, hold_ns
        self.last: list[Row] | None = None
        self.since: int | None = None
        self.fired = False
        self.told = -1

    def poll(self, df: DataFrame, now_ns: int = 0) -> list[Row]:
        """What the data has to say now."""
        rows = self.query(df).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a standing query's result has more than {MOST_ROWS} rows")
        if self.mode == "rows":
            return rows
        if self.mode == "on_change":
            rows = sorted(rows, key=str)
            changed = rows != self.last
            self.last = rows
            return rows if changed else []
        number = rows[0][0] if rows else None
        if number is None or not self.op(number, self.value):
            self.since, self.fired = None, False
            return []
        if self.since is None:
            self.since = now_ns
        if self.fired or now_ns - self.since < self.hold_ns:
            return []
        self.fired = True
        return rows

    def attach(self, stream: DataFrame, sink: Callable[[int, list[Row]], None], clock: Callable[[], int], state: str | None = None, **options):
        """Run over the batches of a stream; a batch that is replayed is not told twice.

        Numbers of batches rise, so the last one told is all that is remembered; with
        ``state`` (a folder) it is written down there and holds after a restart too.
        """
        spark = stream.sparkSession
        if state and (held := _numbers(spark, state)):
            self.told = max(self.told, max(held))

        def each(batch: DataFrame, number: int) -> None:
            if number <= self.told:
                return
            found = self.poll(batch, clock())
            if found:
                sink(number, found)
            self.told = number
            if state:
                _write_number(spark, state, number)

        writer = stream.writeStream.foreachBatch(each)
        for k, v in options.items():
            writer = writer.option(k, v)
        return writer.trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _numbers(spark: SparkSession, state: str) -> list[int]:
    fs, where = _fs(spark, state)
    return [int(f.getPath().getName()[6:]) for f in fs.listStatus(where) if f.getPath().getName().startswith("batch-")] if fs.exists(where) else []


def _write_number(spark: SparkSession, state: str, number: int) -> None:
    """An empty file with the number in its name; older ones go."""
    fs, where = _fs(spark, f"{state}/batch-{number}")
    fs.create(where, True).close()
    for old in _numbers(spark, state):
        if old < number:
            fs.delete(_fs(spark, f"{state}/batch-{old}")[1], False)
