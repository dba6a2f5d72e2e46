"""Append-only tables of Parquet files under a manifest.

A table is a folder: ``manifest-N.json`` files, of which the highest N counts, and
data files in ``hour=...`` folders, later merged into ``day=...`` ones.  A commit
writes the next manifest under a new name, which fails if another writer was first;
readers see all of a commit or nothing.  The manifest holds for each file its rows and
the smallest and largest values of the statistics columns, so a query with bounds
reads only files that can hold matching rows.

Columns may be added, and ints and floats widen to doubles, other mixes to strings;
files that lack a column read NULL.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both."""
    if a == b:
        return a
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return max(a, b, key=lambda t: whole.index(type(t)))
    number = (*whole, T.FloatType, T.DoubleType)
    if isinstance(a, number) and isinstance(b, number):
        return T.DoubleType()
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    return T.StringType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of both, in the order in which they were first seen."""
    kinds = {f.name: f.dataType for f in a.fields}
    for f in b.fields:
        kinds[f.name] = widened(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


class EventTable:
    """A table at ``location`` with event times in ``time`` (a timestamp, or bigint nanoseconds)."""

    def __init__(self, spark: SparkSession, location: str, time: str = "ts", sort_key: list[str] | None = None, stats: list[str] | None = None, strict: bool = False):
        self.spark, self.location, self.time = spark, location.rstrip("/"), time
        self.sort_key = sort_key or [time]
        self.stats = stats or self.sort_key
        self.strict = strict
        self.refresh()

    # files, by Hadoop's file systems

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def refresh(self) -> None:
        """Read the latest manifest."""
        found = [int(n[9:-5]) for n in self._names(self.location) if n.startswith("manifest-") and n.endswith(".json")]
        self.version = max(found, default=0)
        self.files: list[dict] = []
        #: the last batch of each writer that follows a stream; files that are no longer read, and since when
        self.batches: dict[str, int] = {}
        self.gone: list[list] = []
        self.schema: T.StructType | None = None
        if self.version:
            fs, where = self._fs(f"{self.location}/manifest-{self.version}.json")
            stream = fs.open(where)
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            held = json.loads(text)
            self.files, self.batches, self.gone = held["files"], held.get("batches", {}), held.get("gone", [])
            self.schema = T.StructType.fromJson(held["schema"])

    def _commit(self, files: list[dict], schema: T.StructType, batch: tuple[str, int] | None = None, gone: list[list] | None = None) -> None:
        """Write the next manifest; a rename to a name that exists fails.

        The manifest also says which batch of a stream it holds, so what is replayed
        after a failure is known whoever replays it.
        """
        batches = self.batches | ({batch[0]: batch[1]} if batch else {})
        kept = {f["path"] for f in files}
        left = [[f["path"], time.time_ns()] for f in self.files if f["path"] not in kept]
        held = {"files": files, "schema": json.loads(schema.json()), "batches": batches, "gone": (self.gone if gone is None else gone) + left}
        body = json.dumps(held)
        fs, part = self._fs(f"{self.location}/.tmp-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(body.encode("utf-8")))
        out.close()
        _, target = self._fs(f"{self.location}/manifest-{self.version + 1}.json")
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise RuntimeError("another writer committed first; refresh and try again")
        self.refresh()

    def _moment(self) -> F.Column:
        kind = self.schema[self.time].dataType if self.schema else None
        return F.timestamp_micros(F.floor(F.col(self.time) / 1000)) if isinstance(kind, T.LongType) else F.col(self.time).cast("timestamp")

    def _write(self, df: DataFrame, tier: str) -> list[dict]:
        """Files of sorted rows in folders by hour or day, with their statistics."""
        folder = f"{self.location}/{tier}-{uuid.uuid4().hex}"
        pattern = "yyyy-MM-dd-HH" if tier == "hour" else "yyyy-MM-dd"
        cut = df.withColumn("__part", F.coalesce(F.date_format(self._moment(), pattern), F.lit("none")))
        # rows of a part come together, and parts with very many rows are split
        cut = cut.hint("rebalance", F.col("__part")).sortWithinPartitions("__part", *self.sort_key)
        cut.write.partitionBy("__part").parquet(folder)
        # statistics from what was written
        held = self.spark.read.parquet(folder).withColumn("__file", F.input_file_name())
        named = [x for s in self.stats if s in df.columns for x in (F.min(s).cast("string").alias(f"min_{s}"), F.max(s).cast("string").alias(f"max_{s}"))]
        rows = held.groupBy("__file", "__part").agg(F.count(F.lit(1)).alias("n"), *named).collect()
        return [
            {"path": r["__file"], "part": str(r["__part"]), "tier": tier, "rows": r["n"], "min": {s: r[f"min_{s}"] for s in self.stats if s in df.columns}, "max": {s: r[f"max_{s}"] for s in self.stats if s in df.columns}}
            for r in rows
        ]

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add rows: one commit.  ``batch``: the writer and number of a stream's batch; one that is held is not added again."""
        if batch and self.batches.get(batch[0], -1) >= batch[1]:
            return
        new = merged(self.schema, df.schema) if self.schema else df.schema
        if self.strict and self.schema and new != self.schema:
            raise ValueError("rows don't fit the table's schema")
        before, self.schema = self.schema, new
        try:
            files = self._write(df, "hour")
            self._commit(self.files + files, new, batch)
        except Exception:
            self.schema = before
            raise

    def compact(self) -> int:
        """Merge hour files into day files sorted by ``sort_key``; returns how many files went."""
        hours = [f for f in self.files if f["tier"] == "hour"]
        if not hours:
            return 0
        files = self._write(self._read(hours), "day")
        self._commit([f for f in self.files if f["tier"] != "hour"] + files, self.schema)
        return len(hours)

    def retain(self, days: int, now: str) -> int:
        """Drop files of days more than ``days`` before ``now`` (a date); returns how many."""
        import datetime

        first = (datetime.date.fromisoformat(now) - datetime.timedelta(days=days)).isoformat()
        kept = [f for f in self.files if f["part"] == "none" or f["part"][:10] >= first]
        gone = len(self.files) - len(kept)
        if gone:
            self._commit(kept, self.schema)
        return gone

    def _read(self, files: list[dict]) -> DataFrame:
        """Rows of files under the table's schema: files are read by the schema that they have."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        groups: dict[str, list[str]] = {}
        for f in files:
            groups.setdefault(f["path"].rsplit("/", 2)[0], []).append(f["path"])
        frames = []
        for paths in groups.values():
            df = self.spark.read.parquet(*paths)
            frames.append(df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in self.schema.fields]))
        return reduce(DataFrame.unionByName, frames)

    def candidates(self, bounds: dict[str, tuple[object, object]] | None = None) -> list[dict]:
        """Files whose statistics overlap ``bounds`` (column: lowest, highest; None: open)."""

        def compare(value: str, bound: object) -> int:
            if isinstance(bound, (int, float)) and not isinstance(bound, bool):
                x = float(value)
                return (x > bound) - (x < bound)
            return (value > str(bound)) - (value < str(bound))

        def can(f: dict) -> bool:
            for c, (lo, hi) in (bounds or {}).items():
                if f["min"].get(c) is None:
                    continue
                if hi is not None and compare(f["min"][c], hi) > 0 or lo is not None and compare(f["max"][c], lo) < 0:
                    return False
            return True

        return [f for f in self.files if can(f)]

    def snapshot(self, where: str | None = None, bounds: dict[str, tuple[object, object]] | None = None) -> DataFrame:
        """The rows of the last commit, filtered; with ``bounds`` only files that can match are read."""
        from sparkloom.sql import expr

        df = self._read(self.candidates(bounds))
        for c, (lo, hi) in (bounds or {}).items():
            kind = self.schema[c].dataType
            if lo is not None:
                df = df.where(F.col(c) >= F.lit(lo).cast(kind))
            if hi is not None:
                df = df.where(F.col(c) <= F.lit(hi).cast(kind))
        return df.where(expr(where)) if where else df

    def vacuum(self, grace_ns: int = 0, now_ns: int | None = None) -> int:
        """Delete files that no manifest has read for ``grace_ns``; returns how many."""
        now = time.time_ns() if now_ns is None else now_ns
        old = [g for g in self.gone if now - g[1] >= grace_ns]
        for path, _ in old:
            fs, where = self._fs(path)
            fs.delete(where, False)
        if old:
            self._commit(self.files, self.schema, gone=[g for g in self.gone if now - g[1] < grace_ns])
        return len(old)

    def follow(self, stream: DataFrame, checkpoint: str):
        """Append the batches of a stream; a replayed batch is not added twice, whichever process replays it."""

        def each(batch: DataFrame, number: int) -> None:
            self.refresh()
            self.append(batch, (checkpoint, number))

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
