"""A Spark data source for tables of SQLite files, opened read-only.

``spark.dataSource.register(SqliteSource)``, then
``spark.read.format("sqlite").option("path", ...).option("table", "scenes").load()``.
A table is read in ranges of row ids, one connection a range; column types are
those that the table declares. Options column, low and high restrict the rows
within the file. Files must lie where every executor finds them.
"""

from __future__ import annotations

import re
import sqlite3
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_A_RANGE = 50_000
#: Declared types and what they are read as.
TYPES = {"INT": (T.LongType(), pa.int64()), "CHAR": (T.StringType(), pa.string()), "TEXT": (T.StringType(), pa.string()), "BLOB": (T.BinaryType(), pa.binary()), "REAL": (T.DoubleType(), pa.float64()), "FLOA": (T.DoubleType(), pa.float64()), "DOUB": (T.DoubleType(), pa.float64())}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro&immutable=1", uri=True)


def _name(table: str) -> str:
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"not a table's name: {table}")
    return f'"{table}"'


def _columns(path: str, table: str) -> list[tuple[str, T.DataType, pa.DataType]]:
    with _open(path) as db:
        found = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table}")
    kind = lambda declared: next((v for k, v in TYPES.items() if k in declared.upper()), TYPES["TEXT"])
    return [(row[1], *kind(row[2])) for row in found]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t, _ in _columns(self.options["path"], self.options["table"])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options["table"]
        self.column = options.get("column")
        self.bounds = (int(options["low"]), int(options["high"])) if self.column else ()

    def _where(self) -> str:
        return f" AND {_name(self.column)} BETWEEN ? AND ?" if self.column else ""

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)} WHERE true{self._where()}", self.bounds).fetchone()
        return [_Range(k, min(k + ROWS_A_RANGE - 1, high)) for k in range(low, high + 1, ROWS_A_RANGE)] if low is not None else [_Range(0, -1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        columns = _columns(self.path, self.table)
        names = ", ".join(f'"{n}"' for n, _, _ in columns)
        with _open(self.path) as db:
            cursor = db.execute(f"SELECT {names} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?{self._where()} ORDER BY rowid", (partition.low, partition.high, *self.bounds))
            while rows := cursor.fetchmany(2000):
                yield pa.RecordBatch.from_arrays([pa.array(values, t) for values, (_, _, t) in zip(zip(*rows), columns)], [n for n, _, _ in columns])


def read_table(spark: SparkSession, path: str, table: str, *, between: tuple[str, int, int] | None = None) -> DataFrame:
    """A table; with a column, a first and a last value the file is asked for these rows only."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table)
    if between is not None:
        reader = reader.option("column", between[0]).option("low", str(between[1])).option("high", str(between[2]))
    return reader.load()


def inflate(payload: Column) -> Column:
    """The text of a zlib-compressed binary column."""

    @F.pandas_udf("string")
    def of(values):
        return values.map(lambda v: None if v is None else zlib.decompress(v).decode())

    return of(payload)
