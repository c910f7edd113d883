"""Tables merged by bucket: an upsert or a delete rewrites only the buckets of the keys that it touches.

A bucket is a hash of the key. data/<folder>/__b=<bucket> has a bucket's rows in Parquet, and _versions/<number>.json names the folder that
counts for each bucket. A version file is created once and never changed: readers see whole versions, a writer that comes second raises, and one
that breaks off leaves nothing that counts. A version also remembers the last batch of each stream that it has, so that a batch that is
sent again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from finspan.sources.sinks import _files, written

#: Buckets of a new table. They stay as many: choose so that a bucket of the largest table fits a task.
BUCKETS = 32
_B = "__b"


class Conflict(RuntimeError):
    """Another writer has made the version in the meantime; the same call can be made again."""


@dataclass
class Version:
    number: int = 0
    keys: list[str] = field(default_factory=list)
    buckets: int = BUCKETS
    schema: str = ""
    #: Folder of each bucket that has been written, by the bucket's number.
    data: dict[str, str] = field(default_factory=dict)
    #: Last batch of each stream.
    batches: dict[str, int] = field(default_factory=dict)

    def paths(self, path: str, buckets: list[int] | None = None) -> list[str]:
        return [f"{path}/data/{folder}/{_B}={b}" for b, folder in sorted(self.data.items()) if buckets is None or int(b) in buckets]


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, make = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(make(path))) if fs.exists(make(path)) else []


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last whole version, or an earlier one; number 0, without data, if there is none."""
    found = [x for x in _names(spark, f"{path}/_versions") if x.endswith(".json") and (number is None or int(x[:-5]) == number)]
    for name in reversed(found):
        try:
            return Version(**json.loads("".join(r[0] for r in spark.read.text(f"{path}/_versions/{name}").collect())))
        except ValueError:  # being written
            continue
    if number:
        raise FileNotFoundError(f"no version {number} of {path}")
    return Version()


def _commit(spark: SparkSession, path: str, new: Version) -> None:
    file = f"{path}/_versions/{new.number:012d}.json"
    fs, make = _files(spark, path)
    try:
        out = fs.create(make(file), False)
    except Py4JJavaError as e:
        if fs.exists(make(file)):
            raise Conflict(file) from e
        raise
    try:
        out.write(bytearray(json.dumps(new.__dict__).encode()))
    finally:
        out.close()


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _rows(spark: SparkSession, path: str, v: Version, buckets: list[int] | None = None) -> DataFrame:
    schema, paths = StructType.fromJson(json.loads(v.schema)), v.paths(path, buckets)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table, or an earlier version of it."""
    v = version(spark, path, number)
    if not v.number:
        raise FileNotFoundError(f"no table at {path}")
    return _rows(spark, path, v)


def _greatest(df: DataFrame, keys: list[str], others: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key the one with the greatest order; added up before rows are shuffled, so that a key may have any number of rows."""
    if not others:
        return df.select(_B, *keys).distinct()
    return df.groupBy(_B, *keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row")).select(_B, *keys, *(F.col(f"__row.`{c}`").alias(c) for c in others))


def _replace(spark: SparkSession, path: str, v: Version, rows: DataFrame, touched: list[int], batch: tuple[str, int] | None) -> Version:
    """Commit rows, which have all that stays in the touched buckets."""
    folder = uuid.uuid4().hex
    rows.write.partitionBy(_B).parquet(f"{path}/data/{folder}")
    kept = {n.removeprefix(f"{_B}=") for n in _names(spark, f"{path}/data/{folder}")}
    data = {b: f for b, f in v.data.items() if int(b) not in touched} | {str(b): folder for b in touched if str(b) in kept}
    new = Version(v.number + 1, v.keys, v.buckets, v.schema, data, v.batches | ({batch[0]: batch[1]} if batch else {}))
    _commit(spark, path, new)
    return new


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None, latest: bool = False, buckets: int = BUCKETS, batch: tuple[str, int] | None = None, evolve: bool = False) -> list[int]:
    """Put the rows of new over those of the table at path by key; the buckets that were rewritten.

    Of rows of new with one key, that with the greatest order (by default all other columns, in turn) counts. It replaces the table's row, or
    with latest only if it isn't less in order. Null keys are equal to each other. buckets: of a table that isn't there yet. batch: a stream
    and the number of its batch; batches that the table already has are left out. evolve: columns that the table doesn't have are added to it, null in older rows;
    otherwise they are left out. Columns that new doesn't have are null in its rows; columns of another type raise.
    """
    spark, path = new.sparkSession, path.rstrip("/")
    v = version(spark, path)
    if batch and v.batches.get(batch[0], -1) >= batch[1]:
        return []
    if not v.number:
        v.keys, v.buckets, v.schema = list(keys), buckets, json.dumps(new.schema.jsonValue())
    if v.keys != list(keys):
        raise ValueError(f"the table's keys are {v.keys}")
    v.schema = json.dumps(merged(v, new.schema, evolve).jsonValue())
    schema = StructType.fromJson(json.loads(v.schema))
    columns = schema.names
    new = new.select(*(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
    others = [c for c in columns if c not in keys]
    order = order or others
    new = written(_greatest(new.select(*columns).withColumn(_B, _bucket(keys, v.buckets)), keys, others, order), "upsert")
    touched = sorted(r[0] for r in new.select(_B).distinct().collect())  # the table's buckets at most
    if not touched and v.number:
        return []
    old = _rows(spark, path, v, touched).withColumn(_B, _bucket(keys, v.buckets))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    tasks = max(1, min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = both.repartition(tasks, _B)  # whole buckets: the rows of a key meet without another shuffle, and a bucket is one file
    _replace(spark, path, v, _greatest(both, keys, others, [*order, "__new"] if latest else ["__new"]), touched, batch)
    return touched


def merged(v: Version, new: StructType, evolve: bool) -> StructType:
    """The table's schema with the new columns behind its own if they are wanted; all but keys can be null."""
    old = StructType.fromJson(json.loads(v.schema))
    types = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in types and f.dataType != types[f.name]:
            raise ValueError(f"{f.name} is {types[f.name].simpleString()}, not {f.dataType.simpleString()}")
    more = [f for f in new if f.name not in types] if evolve else []
    return StructType([StructField(f.name, f.dataType) for f in [*old, *more]])


def add_columns(spark: SparkSession, path: str, ddl: str) -> StructType:
    """Add columns that the table doesn't have yet, null in all rows; no file is rewritten."""
    v = version(spark, path)
    schema = merged(v, _parse(spark, ddl), True)
    if json.dumps(schema.jsonValue()) != v.schema:
        _commit(spark, path, Version(v.number + 1, v.keys, v.buckets, json.dumps(schema.jsonValue()), v.data, v.batches))
    return schema


def _parse(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def delete(spark: SparkSession, path: str, condition: Column | str) -> list[int]:
    """Delete the rows for which condition is true; the buckets that were rewritten."""
    path = path.rstrip("/")
    v = version(spark, path)
    condition = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    b = _bucket(v.keys, v.buckets)
    touched = sorted(r[0] for r in _rows(spark, path, v).where(condition).select(b.alias(_B)).distinct().collect())  # the table's buckets at most
    if touched:
        _replace(spark, path, v, _rows(spark, path, v, touched).where(~condition).withColumn(_B, b).repartition(len(touched), _B), touched, None)
    return touched


def retain(spark: SparkSession, path: str, time: str, days: int) -> list[int]:
    """Delete the rows that are `days` days or more before the latest one; the buckets that were rewritten."""
    last = read(spark, path).agg(F.max(time)).first()[0]
    return [] if last is None else delete(spark, path, F.col(time) <= F.lit(last) - F.make_dt_interval(F.lit(days)))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all versions but the last ones, and the folders that none of these names, also of writers that broke off; how many folders.

    Not beside a writer or a reader of an older version.
    """
    fs, make = _files(spark, path)
    numbers = [int(x[:-5]) for x in _names(spark, f"{path}/_versions") if x.endswith(".json")]
    used = {f for n in numbers[-keep:] for f in version(spark, path, n).data.values()}
    gone = [x for x in _names(spark, f"{path}/data") if x not in used]
    for n in numbers[:-keep]:
        fs.delete(make(f"{path}/_versions/{n:012d}.json"), False)
    for x in gone:
        fs.delete(make(f"{path}/data/{x}"), True)
    return len(gone)
