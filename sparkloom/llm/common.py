"""Helpers shared by the corpus operators: paths, scratch tables, bounded samples."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import ship

_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``; also sees that workers have this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` when the session names one, otherwise the context's
    checkpoint folder, otherwise (local sessions only) a folder of this process
    which is removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if not _OWN_SCRATCH:
            _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="sparkloom-"))
            atexit.register(shutil.rmtree, _OWN_SCRATCH[0], True)
        named = "file://" + _OWN_SCRATCH[0]
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage without executor-local state: a lost executor rereads the
    written files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove what :func:`materialise` wrote for ``df``, once nothing reads it."""
    drop_path(df.sparkSession, df._sparkloom_path)


def bounded_rows(df: DataFrame, key: str, rows: int, seed: str = "sample") -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has fewer), the same ones at every run.

    Rows are taken by a hash of ``key`` against a threshold worked out from the row
    count, so no sort and no single task sees the table.  The expected size is
    ``rows``; the deviation is a few times its square root.
    """
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < share)


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows ``key`` and ``__y`` (0 or 1), one for each key with a label and no contradictory ones."""
    known = labels.select(key, F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1))
    one = known.groupBy(key).agg(F.min("__y").alias("__y"), F.max("__y").alias("__most"))
    return one.where("__y = __most").select(key, "__y")


def lots(batches: Iterator, column: int, most: int = 4_000_000) -> Iterator:
    """Batches in slices of at most about ``most`` bytes of a text column (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
            at = done = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, done + most, "right")))
                yield batch.slice(at, stop - at)
                at, done = stop, int(size[stop - 1])


def crc_mod(key: str, by: int):
    """crc32 of a column's text, modulo ``by``; of null, that of no text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
