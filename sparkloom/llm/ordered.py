"""Rows dealt to partitions in ascending key order, each partition sorted.

Unlike a range repartition the ranges are known here, so a partition can also be
given the row that follows its last one, and places in the whole order can be worked
out from one number for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEAST = np.iinfo(np.int64).min


def _even(pieces: int) -> list[int]:
    """Numbers that cut the range of hashes into so many pieces."""
    return [_LEAST + k * ((1 << 64) // pieces) for k in range(1, pieces)]


class _Edges:
    """Where ranges of (key, hash) begin, nulls first."""

    def __init__(self, cuts: list[int], null_ranges: int, nulls: bool):
        own, many = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.null = np.array(_even(max(1, null_ranges)), np.int64)
        self.base = len(self.null) + bool(nulls)
        self.key = np.repeat(own, many)
        self.hash = np.array([h for m in many.tolist() for h in [_LEAST, *_even(m)]], np.int64)
        self.n = self.base + len(self.key) + 1

    def of(self, null: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The range of each row."""
        low, at = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        several = (at - low > 1) & ~null
        for k in np.unique(keys[several]).tolist():
            own = several & (keys == k)
            a, b = np.searchsorted(self.key, k, "left"), np.searchsorted(self.key, k, "right")
            at[own] = a + np.searchsorted(self.hash[a:b], hashes[own], "right")
        return np.where(null, np.searchsorted(self.null, hashes, "right"), self.base + at)


def _placed(batch, edges: _Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (key, text, hash): which keys are null, keys (0 for null), hashes, ranges."""
    keys = batch.column(0)
    null, values, hashes = keys.is_null().to_numpy(zero_copy_only=False), keys.fill_null(0).to_numpy(), batch.column(2).to_numpy()
    return null, values, hashes, edges.of(null, values, hashes)


def _followers(given: DataFrame, edges: _Edges) -> dict[tuple[bool, int, int], int]:
    """For the first (null, key, hash) of each range the range before it; one row a range is collected."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            null, keys, hashes, at = _placed(batch, edges)
            order = np.lexsort((hashes, keys, ~null, at))
            first = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))[: len(order)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[first]) for x in (at.astype(np.int64), ~null, keys, hashes)], ["part", "known", "key", "hash"]
            )

    firsts = given.select("__key", F.lit(None).cast("string").alias("none"), "__hash").mapInArrow(run, "part bigint, known boolean, key bigint, hash bigint")
    rows = sorted(firsts.groupBy("part").agg(F.min(F.struct("known", "key", "hash")).alias("f")).collect())
    return {(not r.f.known, r.f.key, r.f.hash): rows[k - 1].part for k, r in enumerate(rows)}


def in_order(docs: DataFrame, key: str, text: str, followed: bool = False) -> tuple[DataFrame, int]:
    """Columns ``__part`` (int), ``__tail`` (boolean), ``__key`` and ``__text`` and the number of partitions.

    Partition p holds the rows with ``__part`` = p sorted by key (nulls first), then by
    a hash of the text.  With ``followed`` there are, behind a partition's own rows,
    copies with ``__tail`` of the rows that come first behind it (behind the last
    partition the first of all).  Ranges are cut at quantiles of the keys; a key (or
    null) that fills several ranges is cut by the hash, so only rows with the same key
    and text stay together.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(key).cast("bigint").alias("__key"), F.col(text).alias("__text"))
    given = given.withColumn("__hash", F.xxhash64("__text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    row = given.agg(
        F.percentile_approx("__key", F.array(*[F.lit(s) for s in shares]), F.lit(max(10_000, 20 * parts))).alias("cuts"),
        F.sum(F.col("__key").isNull().cast("bigint")).alias("nulls"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    edges = _Edges((row.cuts or []) if parts > 1 else [], (row.nulls or 0) * parts // max(1, row.n), bool(row.nulls))
    n = edges.n
    behind = _followers(given, edges) if followed else {}

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        firsts = np.array([k for _, k, _ in behind], np.int64)
        for batch in batches:
            null, values, hashes, at = _placed(batch, edges)
            rows, part = [np.arange(len(values))], [at]
            for k in np.flatnonzero(np.isin(values, firsts)).tolist():
                before = behind.get((bool(null[k]), int(values[k]), int(hashes[k])))
                if before is not None:
                    rows.append(np.array([k]))
                    part.append(np.array([before]))
            tail = np.arange(len(values) + len(rows) - 1) >= len(values)
            taken = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(part).astype(np.int32)), pa.array(tail), *(batch.column(c).take(taken) for c in range(3))],
                ["__part", "__tail", "__key", "__text", "__hash"],
            )

    schema = T.StructType.fromDDL("__part int, __tail boolean, __key bigint, __text string, __hash bigint")
    dealt = given.mapInArrow(deal, schema).repartitionById(n, F.col("__part"))
    order = ["__part", "__tail", F.asc_nulls_first("__key"), "__hash", F.asc_nulls_first("__text")]
    return dealt.sortWithinPartitions(*order).drop("__hash"), n
