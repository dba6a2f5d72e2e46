"""Changes of tables as DataFrames: what a table is after a statement.

Tables are immutable; a change gives a new DataFrame, and :class:`Database` keeps the
current one of each name, with transactions and constraints.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sql import expr, query


class ConstraintError(ValueError):
    """A change would break a constraint."""


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` added, by column name; columns they lack are NULL."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def delete(table: DataFrame, where: str) -> DataFrame:
    """Rows for which ``where`` is false or unknown."""
    return table.where(~F.coalesce(expr(where).cast("boolean"), F.lit(False)))


def update(table: DataFrame, changes: dict[str, str], where: str | None = None) -> DataFrame:
    """Columns set to expressions over the old row, where ``where`` is true."""
    hit = F.coalesce(expr(where).cast("boolean"), F.lit(False)) if where else F.lit(True)
    types = {f.name: f.dataType for f in table.schema.fields}
    return table.select(
        *[F.when(hit, expr(changes[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns]
    )


def upsert(table: DataFrame, rows: DataFrame, key: list[str], changes: dict[str, str] | None = None) -> DataFrame:
    """Rows whose key is new are added; others change the old row, or nothing.

    ``changes`` maps columns to expressions over the old columns and ``excluded.``
    columns; None: DO NOTHING.  Keys of ``rows`` must be unique, or the one that stays
    is any of them.
    """
    rows = rows.select(*[c for c in table.columns if c in rows.columns]).dropDuplicates(key)
    new = rows.join(table.select(*key), key, "left_anti")
    if changes is None:
        return insert(table, new)
    old, excluded = table.alias("t"), rows.alias("excluded")
    on = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in key]
    joined = old.join(excluded, on, "left")
    hit = F.col(f"excluded.{key[0]}").isNotNull()
    types = {f.name: f.dataType for f in table.schema.fields}
    changed = joined.select(
        *[F.when(hit, expr(changes[c]).cast(types[c])).otherwise(F.col(f"t.{c}")).alias(c) if c in changes else F.col(f"t.{c}").alias(c) for c in table.columns]
    )
    return insert(changed, new)


def replace(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """INSERT OR REPLACE: rows with the same key go."""
    rows = rows.dropDuplicates(key)
    return insert(table.join(rows.select(*key), key, "left_anti").select(*table.columns), rows)


@dataclass
class Constraints:
    """What must hold for all rows of a table."""

    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    check: list[str] = field(default_factory=list)
    default: dict[str, str] = field(default_factory=dict)

    def verify(self, table: DataFrame) -> None:
        """Raise if a row breaks a constraint; a check that is unknown holds.

        One pass over the rows for all NOT NULL and CHECK rules, and one aggregation
        for each unique key.
        """
        rules = [(F.col(c).isNull(), f"NOT NULL constraint failed: {c}") for c in self.not_null]
        rules += [(~expr(c), f"CHECK constraint failed: {c}") for c in self.check]
        if rules:
            broken = table.agg(*[F.bool_or(F.coalesce(rule, F.lit(False))).alias(f"r{k}") for k, (rule, _) in enumerate(rules)]).first()
            for k, (_, text) in enumerate(rules):
                if broken[k]:
                    raise ConstraintError(text)
        for key in self.unique:
            known = table.dropna(subset=key)
            if not known.groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(key)}")


class Database:
    """Named tables that can change, as temporary views; BEGIN, COMMIT and ROLLBACK."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.rules: dict[str, Constraints] = {}
        self._saved: list[tuple[dict, dict]] = []
        self._changes: dict[str, int] = {}
        #: rows changed by the last statement and by all, and the last integer key inserted
        self.changes = self.total_changes = 0
        self.last_insert_rowid: int | None = None

    def create(self, name: str, table: DataFrame | str, rules: Constraints | None = None, if_not_exists: bool = False) -> None:
        """A table from a DataFrame, or an empty one from a column list."""
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} already exists")
        self.rules[name] = rules or Constraints()
        self._put(name, table if isinstance(table, DataFrame) else self.spark.createDataFrame([], table))

    def create_view(self, name: str, sql: str) -> None:
        query(self.spark, sql).createOrReplaceTempView(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.tables and not if_exists:
            raise ValueError(f"no such table: {name}")
        self.tables.pop(name, None)
        self.rules.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def _put(self, name: str, table: DataFrame) -> None:
        self.rules[name].verify(table)
        self._changes[name] = self._changes.get(name, 0) + 1
        if self._changes[name] % 10 == 0 and self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            table = table.checkpoint()  # plans of many changes grow long
        self.tables[name] = table
        table.createOrReplaceTempView(name)

    def insert(self, name: str, rows: DataFrame, conflict: str = "abort") -> None:
        """``conflict``: abort, ignore or replace on the first unique key."""
        table, rules = self.tables[name], self.rules[name]
        for c, e in rules.default.items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), expr(e)) if c in rows.columns else expr(e))
        if conflict == "ignore" and rules.unique:
            new = upsert(table, rows, rules.unique[0])
        elif conflict == "replace" and rules.unique:
            new = replace(table, rows, rules.unique[0])
        else:
            new = insert(table, rows)
        try:
            self._put(name, new)
        except ConstraintError:
            if conflict == "rollback" and self._saved:
                self.rollback()
            raise
        n = rows.count() if conflict != "ignore" else new.count() - table.count()
        self._counted(n)
        key = next((k[0] for k in rules.unique if len(k) == 1), None)
        if n and key and rows.schema[key].dataType.simpleString() == "bigint":
            self.last_insert_rowid = rows.agg(F.max(key)).first()[0]

    def _counted(self, n: int) -> None:
        self.changes = n
        self.total_changes += n

    def update(self, name: str, changes: dict[str, str], where: str | None = None) -> None:
        table = self.tables[name]
        n = (table.where(expr(where)) if where else table).count()
        self._put(name, update(table, changes, where))
        self._counted(n)

    def delete(self, name: str, where: str = "true") -> None:
        table = self.tables[name]
        n = table.where(expr(where)).count()
        self._put(name, delete(table, where))
        self._counted(n)

    def upsert(self, name: str, rows: DataFrame, key: list[str], changes: dict[str, str] | None = None) -> None:
        table = self.tables[name]
        new = upsert(table, rows, key, changes)
        self._put(name, new)
        self._counted(rows.count() if changes else new.count() - table.count())

    def begin(self) -> None:
        self._saved.append((dict(self.tables), dict(self.rules)))

    def commit(self) -> None:
        self._saved.pop()

    def rollback(self) -> None:
        """All names as they were at the last BEGIN."""
        now = set(self.tables)
        self.tables, self.rules = self._saved.pop()
        for name in now - set(self.tables):
            self.spark.catalog.dropTempView(name)
        for name, table in self.tables.items():
            table.createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """A query; changes(), total_changes() and last_insert_rowid() are this database's."""
        for name in ("total_changes", "changes", "last_insert_rowid"):
            value = getattr(self, name)
            text = re.sub(rf"\b{name}\s*\(\s*\)", "NULL" if value is None else str(value), text, flags=re.IGNORECASE)
        return query(self.spark, text)
