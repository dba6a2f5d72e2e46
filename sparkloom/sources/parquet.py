"""Parquet files, folders, bytes and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, Row, SparkSession


def open_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Read a Parquet file or folder and name a view after it (``orders.parquet``: orders)."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name or PurePath(path.rstrip("/")).stem)
    return df


def from_bytes(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """A view over a Parquet file held in memory on the driver."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    df = spark.createDataFrame(pq.read_table(pa.BufferReader(data)))
    df.createOrReplaceTempView(name)
    return df


def write(df: DataFrame, path: str, sort: list[str] | None = None, files: int | None = None, codec: str = "zstd", block_mb: int = 128) -> None:
    """Write ``df``; with ``sort``, files hold ranges of those columns so that statistics prune reads."""
    if sort:
        df = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
        df = df.sortWithinPartitions(*sort)
    elif files:
        df = df.repartition(files)
    df.write.option("compression", codec).option("parquet.block.size", block_mb << 20).parquet(path)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows of a plan, one partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def matches(df: DataFrame, predicate: str, row: dict) -> bool | None:
    """Whether one row passes a predicate in the front door's dialect (None: unknown)."""
    from sparkloom.sql import expr

    spark = df.sparkSession
    return spark.createDataFrame([row], df.schema).select(expr(predicate).cast("boolean").alias("p")).first().p
