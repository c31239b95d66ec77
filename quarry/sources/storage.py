"""Text loading and stored tables: heap (arrival order) and sorted.

A stored table is a folder with Parquet versions and, for each version, a
small text of metadata, all written by Spark, so that any store Spark
reaches will do. The highest version whose metadata is complete is the
table, so a job that is lost on the way leaves the one before. Rows added
to a sorted table gather beside it, as sorted runs; the next read merges all
of them with the table into its next version, however many adds there were.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.predicates import cnf_column, index_prefix
from quarry.functions.scope import Scope
from quarry.lang.ast import Operand
from quarry.lang.parser import parse_cnf


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text of fields that each end with a bar; empty fields become 0, 0.0 or the empty string."""
    df = spark.read.schema(schema).option("sep", "|").option("quote", "").csv(path)
    empty = lambda f: F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType)
    return df.select(*(F.coalesce(f.name, empty(f)).alias(f.name) for f in schema.fields))


def write_tbl(df: DataFrame, path: str) -> None:
    line = F.concat(*(F.concat(F.col(c).cast("string"), F.lit("|")) for c in df.columns))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def compose(spark: SparkSession, lines: list[str], schema: T.StructType) -> DataFrame:
    """Records from strings of the same text form."""
    make = {T.IntegerType: lambda v: int(v or 0), T.DoubleType: lambda v: float(v or 0), T.StringType: str}
    rows = [tuple(make[type(f.dataType)](v) for f, v in zip(schema.fields, line.split("|"), strict=False)) for line in lines]
    return spark.createDataFrame(rows, schema)


class NoTable(ValueError):
    """Nothing complete is stored at a path."""


@dataclass
class StoredTable:
    spark: SparkSession
    path: str
    schema: T.StructType
    order: list[str]
    version: int = 0

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, order: list[str] | None = None) -> StoredTable:
        """order: the sort keys of a sorted table; without them a heap. A table that was there is replaced."""
        table = StoredTable(spark, path, schema, list(order or []))
        table.version = max(table._versions(), default=-1) + 1
        spark.createDataFrame([], schema).write.parquet(table._data())
        table._save()
        return table

    @staticmethod
    def open(spark: SparkSession, path: str) -> StoredTable:
        table = StoredTable(spark, path, T.StructType(), [])
        table._to_latest()
        kind, version, schema, *order = spark.read.text(f"{path}/meta-{table.version}", wholetext=True).first()["value"].splitlines()
        if kind not in ("heap", "sorted"):
            raise ValueError(f"{path} is a table of the unknown kind {kind}")
        return StoredTable(spark, path, T.StructType.fromJson(json.loads(schema)), order, int(version))

    def _data(self) -> str:
        return f"{self.path}/v{self.version}"

    def _added(self) -> str:
        return f"added-{self.version}"

    def _store(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _is_there(self, name: str) -> bool:
        store, path = self._store(name)
        return store.exists(path)

    def _versions(self) -> list[int]:
        """Versions that have anything, complete or not."""
        store, path = self._store()
        names = [status.getPath().getName() for status in store.listStatus(path)] if store.exists(path) else []
        return sorted({int(found[1]) for n in names if (found := re.fullmatch(r"(?:v|meta-)(\d+)", n))})

    def _to_latest(self) -> None:
        """To the highest complete version, which may be another writer's."""
        complete = [v for v in self._versions() if self._is_there(f"meta-{v}/_SUCCESS")]
        if not complete:
            raise NoTable(f"there is no table at {self.path}")
        self.version = max(complete)

    def _save(self) -> None:
        lines = ["sorted" if self.order else "heap", str(self.version), self.schema.json(), *self.order]
        self.spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{self.path}/meta-{self.version}")

    def _rows(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def add(self, rows: DataFrame) -> None:
        """To a heap at its end; beside a sorted table, as a sorted run."""
        rows = rows.select(*self.schema.names)
        self._to_latest()
        if self.order:
            rows.sortWithinPartitions(*self.order).write.mode("append").parquet(f"{self.path}/{self._added()}")
        else:
            rows.write.mode("append").parquet(self._data())

    def load(self, path: str) -> None:
        """Adds the rows of a bar-separated text."""
        self.add(read_tbl(self.spark, path, self.schema))

    def merge(self) -> None:
        """Makes table and added rows the next version of a sorted table; nothing where nothing was added.

        The version before stays, for readers that are still at it.
        """
        self._to_latest()
        if not self.order or not self._is_there(self._added()):
            return
        merged = self._rows(self._data()).unionByName(self._rows(f"{self.path}/{self._added()}"))
        before, self.version = self.version, max(self._versions()) + 1
        try:
            merged.orderBy(*self.order).write.parquet(self._data())
            self._save()
        except Exception:
            self.version = before
            raise
        for old in self._versions():
            if old not in (before, self.version):
                for name in (f"v{old}", f"added-{old}", f"meta-{old}"):
                    store, path = self._store(name)
                    store.delete(path, True)

    def scan(self) -> DataFrame:
        """Rows, of a sorted table in order."""
        self.merge()
        df = self._rows(self._data())
        return df.orderBy(*self.order) if self.order else df

    def scan_where(self, cnf: str) -> DataFrame:
        """Rows that satisfy a predicate; on a sorted table its key prefix lets the scan skip row groups."""
        self.merge()
        df = self._rows(self._data())
        df = df.where(cnf_column(parse_cnf(cnf), Scope.of(df)))
        return df.orderBy(*self.order) if self.order else df

    def key_prefix(self, cnf: str) -> list[tuple[str, Operand]]:
        return index_prefix(parse_cnf(cnf), self.order)
