"""SQLite catalogs as a Spark data source.

A catalog is one database file, or a folder in which each table is a folder of database files (shards). Shards are split by ranges of
row numbers and read in parallel; conditions run inside SQLite, where an index can serve them, and only the named columns are fetched.
Writers make one shard for each task, and a table's CURRENT file, replaced at once, names the versions that count. Catalogs are opened
read-only, any number of them side by side. Paths are of a file system that all executors mount.
"""

from __future__ import annotations

import json
import math
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

#: Spark's types and the declared types that stand for them; decimals are kept as text, dates in ISO form. NaN becomes null, as SQLite has none.
DECLARED = {
    "bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "TINYINT", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "FLOAT",
    "string": "TEXT", "binary": "BLOB", "date": "DATE",
}
_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "boolean": pa.bool_(), "double": pa.float64(), "float": pa.float32(),
    "string": pa.string(), "binary": pa.binary(), "date": pa.date32(),
}
CURRENT, FETCH, ROWS = "CURRENT", 10_000, 1_000_000


def local(path: str) -> str:
    """A path without file:; other schemes raise, as SQLite opens files only."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"SQLite can't open {path}: give a mounted path")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def shards(catalog: str, table: str) -> list[str]:
    """The database files that have the table."""
    catalog = local(catalog)
    if os.path.isfile(catalog):
        return [catalog]
    folder = os.path.join(catalog, table)
    try:
        with open(os.path.join(folder, CURRENT)) as f:
            versions = json.load(f)
    except FileNotFoundError:
        raise FileNotFoundError(f"no table {table} in {catalog}") from None
    return [os.path.join(folder, v, x) for v in versions for x in sorted(os.listdir(os.path.join(folder, v)))]


def _spark_type(declared: str) -> str:
    """A declared type as Spark's, by SQLite's rules of affinity where it isn't one of ours."""
    d = declared.upper().strip()
    for spark, own in DECLARED.items():
        if d == own:
            return spark
    if d.startswith("DECTEXT"):
        return "decimal" + d.removeprefix("DECTEXT")
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    return "binary" if "BLOB" in d else "double" if d else "string"


def columns_of(file: str, table: str) -> dict[str, str]:
    with closing(_connect(file)) as c:
        found = {name: _spark_type(kind) for _, name, kind, *_ in c.execute(f"PRAGMA table_info({quoted(table)})")}
    if not found:
        raise ValueError(f"no table {table} in {file}")
    return found


class SQLiteSource(D.DataSource):
    """Options: path (the catalog), dbtable, columns (a JSON list; all if not given), where (a JSON list of column, operator, value), rowsPerPartition,
    pushFilters (true or false), indexes (of a writer; a JSON list of lists).

    With pushFilters, Spark's own filters run inside SQLite as well. Spark 4.1 keeps the filters of a table's last scan for its other scans, which
    then lose rows: so it is off unless asked for, and conditions come by the where option.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> dict[str, str]:
        files = shards(self.options["path"], self.options["dbtable"])
        there = columns_of(files[0], self.options["dbtable"])
        return {c: there[c] for c in json.loads(self.options.get("columns", "null")) or there}

    def _where(self) -> list[D.Filter]:
        return [_filter(*x) for x in json.loads(self.options.get("where", "[]"))]

    def schema(self) -> str:
        return ", ".join(f"{'`' + c.replace('`', '``') + '`'} {t}" for c, t in self._columns().items())

    def reader(self, schema: StructType) -> D.DataSourceReader:
        path, table = self.options["path"], self.options["dbtable"]
        kind = PushingReader if self.options.get("pushFilters") == "true" else SQLiteReader
        reader = kind(path, table, {f.name: f.dataType.simpleString() for f in schema}, int(self.options.get("rowsPerPartition", ROWS)), columns_of(shards(path, table)[0], table))
        if left := list(reader.take(self._where())):
            raise ValueError(f"SQLite can't evaluate {left}")
        return reader

    def writer(self, schema: StructType, overwrite: bool) -> D.DataSourceWriter:
        return SQLiteWriter(self.options["path"], self.options["dbtable"], {f.name: f.dataType.simpleString() for f in schema}, json.loads(self.options.get("indexes", "[]")), overwrite)


#: Operators of conditions: column, operator, value.
OPERATORS = {"=": D.EqualTo, "<=>": D.EqualNullSafe, ">": D.GreaterThan, ">=": D.GreaterThanOrEqual, "<": D.LessThan, "<=": D.LessThanOrEqual, "in": D.In, "starts with": D.StringStartsWith}


def _filter(column: str, operator: str, value=None) -> D.Filter:
    if operator in ("is null", "is not null"):
        return (D.IsNull if operator == "is null" else D.IsNotNull)((column,))
    if operator == "<>":
        return D.Not(D.EqualTo((column,), value))
    return OPERATORS[operator]((column,), tuple(value) if operator == "in" else value)


@dataclass
class Rows(D.InputPartition):
    """The rows of a file with row numbers from first to last; all if none are given, as in a view."""

    file: str
    first: int | None = None
    last: int | None = None


class SQLiteReader(D.DataSourceReader):
    COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}

    def __init__(self, path: str, table: str, types: dict[str, str], rows: int, there: dict[str, str]):
        """types: of the columns to fetch; there: of all of the table's columns."""
        self.path, self.table, self.types, self.rows, self.there = path, table, types, rows, there
        #: Conditions that SQLite evaluates, and their values.
        self.where: list[str] = []
        self.values: list = []

    def _value(self, kind: str, value):
        """A literal as SQLite keeps the column's values; raises where the two compare otherwise than in Spark."""
        if kind in ("bigint", "int", "smallint", "tinyint", "boolean") and isinstance(value, int):
            return int(value)
        if kind == "double" and isinstance(value, int | float) and not math.isnan(value):
            return float(value)
        if kind == "string" and isinstance(value, str):
            return value
        if kind == "date" and isinstance(value, date | str):
            return (value if isinstance(value, date) else date.fromisoformat(value)).isoformat()
        raise TypeError

    def _condition(self, f: D.Filter) -> tuple[str, list]:
        if isinstance(f, D.Not):
            inner, values = self._condition(f.child)
            return f"NOT ({inner})", values
        (name,) = f.attribute  # a nested column raises
        column, kind = quoted(name), self.there[name]
        if isinstance(f, D.IsNull) or isinstance(f, D.EqualNullSafe) and f.value is None:
            return f"{column} IS NULL", []
        if isinstance(f, D.IsNotNull):
            return f"{column} IS NOT NULL", []
        binary = " COLLATE BINARY" if kind == "string" else ""
        if isinstance(f, D.In):
            return f"{column}{binary} IN ({', '.join('?' * len(f.value))})", [self._value(kind, v) for v in f.value]
        if isinstance(f, D.StringStartsWith) and kind == "string":
            return f"substr({column}, 1, {len(f.value)}) = ?{binary}", [self._value(kind, f.value)]
        return f"{column} {self.COMPARED[type(f)]} ?{binary}", [self._value(kind, f.value)]

    def take(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Let SQLite evaluate filters; those that it can't come back."""
        for f in filters:
            try:
                condition, values = self._condition(f)
            except (KeyError, TypeError, ValueError, AttributeError):
                yield f  # Spark's to evaluate
            else:
                self.where.append(condition)
                self.values += values

    def partitions(self) -> Sequence[D.InputPartition]:
        out: list[Rows] = []
        for file in shards(self.path, self.table):
            with closing(_connect(file)) as c:
                if c.execute("SELECT 1 FROM sqlite_master WHERE type = 'view' AND name = ?", [self.table]).fetchone():
                    out.append(Rows(file))
                    continue
                try:
                    first, last = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without row numbers
                    out.append(Rows(file))
                    continue
            if first is not None:
                out += [Rows(file, at, min(at + self.rows - 1, last)) for at in range(first, last + 1, self.rows)]
        return out or [Rows("")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, values = list(self.where), list(self.values)
        if partition.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        sql = f"SELECT {', '.join(map(quoted, self.types)) or '1'} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(f'({x})' for x in where)}" if where else "")
        with closing(_connect(partition.file)) as c:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(FETCH):
                arrays = [_arrow(column, kind) for column, kind in zip(zip(*rows, strict=True), self.types.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(self.types))


class PushingReader(SQLiteReader):
    """Takes the filters of Spark's plan too."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        return self.take(filters)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("decimal"):
        precision, scale = map(int, kind.removeprefix("decimal(").rstrip(")").split(","))
        return pa.decimal128(precision, scale)
    return _ARROW[kind]


def _arrow(values: Sequence, kind: str) -> pa.Array:
    """A column's values; one that isn't of the declared type raises."""
    made = {"date": date.fromisoformat, "boolean": bool, "double": float, "float": float}.get(kind, Decimal if kind.startswith("decimal") else None)
    return pa.array([None if v is None else made(v) for v in values] if made else values, _arrow_type(kind))


@dataclass
class Shard(D.WriterCommitMessage):
    file: str


class SQLiteWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str, table: str, types: dict[str, str], indexes: list[list[str]], overwrite: bool):
        self.folder, self.table, self.types, self.indexes, self.overwrite = os.path.join(local(path), table), table, types, indexes, overwrite
        self.version = f"v-{uuid.uuid4().hex}"

    def _declared(self) -> str:
        kinds = [k.replace("decimal", "DECTEXT") if k.startswith("decimal") else DECLARED[k] for k in self.types.values()]
        return ", ".join(f"{quoted(c)} {k}" for c, k in zip(self.types, kinds, strict=True))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        os.makedirs(os.path.join(self.folder, self.version), exist_ok=True)
        file = os.path.join(self.folder, self.version, f"{uuid.uuid4().hex}.sqlite")
        stored = [(lambda v: v if v is None else v.isoformat()) if k == "date" else (lambda v: v if v is None else str(v)) if k.startswith("decimal") else None for k in self.types.values()]
        with closing(sqlite3.connect(file)) as c:
            c.execute("PRAGMA journal_mode = OFF")  # nobody sees the file before it is whole
            c.execute(f"CREATE TABLE {quoted(self.table)} ({self._declared()})")
            insert = f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.types))})"
            for batch in iterator:
                columns = [x.to_pylist() if f is None else map(f, x.to_pylist()) for x, f in zip(batch.columns, stored, strict=True)]
                c.executemany(insert, zip(*columns, strict=True))
            for i, columns in enumerate(self.indexes):
                c.execute(f"CREATE INDEX {quoted(f'i{i}')} ON {quoted(self.table)} ({', '.join(map(quoted, columns))})")
            c.commit()
        return Shard(os.path.basename(file))

    def commit(self, messages: list[Shard | None]) -> None:
        """Let the new shards count. Files of tasks that were tried again are left out; an overwritten version goes afterwards."""
        folder = os.path.join(self.folder, self.version)
        os.makedirs(folder, exist_ok=True)
        keep = {m.file for m in messages if m is not None}
        for x in set(os.listdir(folder)) - keep:
            os.remove(os.path.join(folder, x))
        if not keep:  # a table without rows has its columns nevertheless
            with closing(sqlite3.connect(os.path.join(folder, "none.sqlite"))) as c:
                c.execute(f"CREATE TABLE {quoted(self.table)} ({self._declared()})")
        pointer = os.path.join(self.folder, CURRENT)
        before: list[str] = []
        if os.path.exists(pointer):
            with open(pointer) as f:
                before = json.load(f)
        new = f"{pointer}-{self.version}"
        with open(new, "w") as f:
            json.dump([self.version] if self.overwrite else [*before, self.version], f)
        os.replace(new, pointer)
        if self.overwrite:
            for v in before:
                shutil.rmtree(os.path.join(self.folder, v), ignore_errors=True)

    def abort(self, messages: list[Shard | None]) -> None:
        shutil.rmtree(os.path.join(self.folder, self.version), ignore_errors=True)


def read(spark: SparkSession, catalog: str, table: str, columns: list[str] | None = None, where: Sequence[tuple] = (), rows_per_partition: int = ROWS, push_filters: bool = False) -> DataFrame:
    """A table of a catalog, or some of its columns and rows.

    where: conditions (column, operator, value) that all hold, with the operators = <=> <> > >= < <= in, starts with, is null, is not null.
    push_filters: let the filters of the plan run there too; such a DataFrame is for one scan, see SQLiteSource.
    """
    spark.dataSource.register(SQLiteSource)
    if push_filters:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("sqlite").option("dbtable", table).option("rowsPerPartition", str(rows_per_partition)).option("where", json.dumps(list(where), default=date.isoformat))
    r = r.option("pushFilters", str(push_filters).lower())
    return (r.option("columns", json.dumps(columns)) if columns else r).load(catalog)


def write(df: DataFrame, catalog: str, table: str, mode: str = "overwrite", indexes: Sequence[Sequence[str]] = ()) -> None:
    """df as a table of a catalog that is a folder, one shard for each task; mode: overwrite or append."""
    df.sparkSession.dataSource.register(SQLiteSource)
    unknown = [f.name for f in df.schema if f.dataType.simpleString() not in DECLARED and not f.dataType.simpleString().startswith("decimal")]
    if unknown:
        raise ValueError(f"SQLite has no type for {', '.join(unknown)}")
    df.write.format("sqlite").option("dbtable", table).option("indexes", json.dumps(list(map(list, indexes)))).mode(mode).save(catalog)
