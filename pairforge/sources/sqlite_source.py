"""SQLite files and SQL dumps as Spark data sources.

``spark.read.format("sqlite").option("path", ...).option("table", ...)`` reads one
table in ranges of row ids; ``format("sqldump")`` replays each dump file in an
in-memory database, one partition for each file, and gives every row as
(file, table, row, data) with ``data`` a JSON object.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def spark_type(declared: str | None):
    """By SQLite's affinity rules."""
    d = (declared or "").upper()
    if "INT" in d or "BOOL" in d:
        return LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return StringType()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def catalog(path: str) -> dict[str, list[tuple[str, str]]]:
    """Tables of a file with their columns and declared types."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {n: [(r[1], r[2]) for r in con.execute(f"PRAGMA table_info({_quoted(n)})")] for n in names}


def _cell(value, kind):
    if value is None:
        return None
    try:
        if isinstance(kind, LongType):
            return int(value)
        if isinstance(kind, DoubleType):
            return float(value)
    except (TypeError, ValueError):
        return None
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", "4"))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            try:
                low, high = con.execute(f"SELECT MIN(rowid), MAX(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view or a table without row ids
                return [Rows(0, -1)]
        if low is None:
            return [Rows(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            names = ", ".join(_quoted(f.name) for f in self.schema)
            sql = f"SELECT {names} FROM {_quoted(self.table)}"
            rows = con.execute(sql) if partition.high == -1 and partition.low == 0 else con.execute(sql + " WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            for row in rows:
                yield tuple(_cell(v, f.dataType) for v, f in zip(row, self.schema, strict=True))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        columns = catalog(self.options["path"])
        table = self.options["table"]
        if table not in columns:
            raise ValueError(f"no table {table!r} in {self.options['path']!r}")
        return StructType([StructField(n, spark_type(t)) for n, t in columns[table]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class Dump(InputPartition):
    def __init__(self, path: str):
        self.path = path


def dump_files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(glob.escape(path), "**", "*.sql"), recursive=True))
    return sorted(glob.glob(path))


def replay(script: str) -> sqlite3.Connection:
    """A dump in an in-memory database."""
    con = sqlite3.connect(":memory:")
    con.executescript(script)
    return con


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table")

    def partitions(self):
        return [Dump(p) for p in dump_files(self.path)]

    def read(self, partition: Dump) -> Iterator[tuple]:
        with open(partition.path, encoding="utf-8") as f:
            con = replay(f.read())
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for name in names:
            if self.table and name.lower() != self.table.lower():
                continue
            cursor = con.execute(f"SELECT * FROM {_quoted(name)}")
            columns = [d[0] for d in cursor.description]
            for i, row in enumerate(cursor):
                data = {c: v.decode("utf-8", "replace") if isinstance(v, bytes) else v for c, v in zip(columns, row, strict=True)}
                yield partition.path, name, i, json.dumps(data, ensure_ascii=False)
        con.close()


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def schema(self) -> str:
        return "file string, table string, row int, data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DumpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(DumpSource)
