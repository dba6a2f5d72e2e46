"""Sessions and the tables that queries name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(app: str = "sparkloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings that the SQL front door relies on: UTC, ANSI, adaptive plans."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k: str(v) for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it where the driver does.

    Functions that run in workers are looked up by module there.
    """
    import shutil
    import tempfile
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(":") or os.getcwd() == root or "site-packages" in root:
        return
    folder = tempfile.mkdtemp(prefix="sparkloom-")
    shutil.copytree(Path(root, "sparkloom"), Path(folder, "pack", "sparkloom"), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(Path(folder, "sparkloom")), "zip", Path(folder, "pack")))
    _SHIPPED.add(app)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{os.fspath(sf_dir)}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views for the named tables (all known ones by default) of ``sf_dir``."""
    for name in names or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
