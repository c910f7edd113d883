"""A catalog of tables merged by bucket, and views over them that are kept beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finspan.sources import buckets
from finspan.sources.sinks import _files

_VIEWS = "_views"


def save_view(spark: SparkSession, catalog: str, name: str, sql: str) -> None:
    """Keep a view under its name; one that is there is replaced."""
    row = spark.createDataFrame([(name, sql)], "name string, sql string")
    buckets.upsert(row, f"{catalog}/{_VIEWS}", ["name"], buckets=1)


def tables(spark: SparkSession, catalog: str) -> list[str]:
    fs, make = _files(spark, catalog)
    return sorted(n for s in fs.listStatus(make(catalog)) if fs.exists(make(f"{catalog}/{(n := s.getPath().getName())}/_versions")) and n != _VIEWS)


def open_catalog(spark: SparkSession, catalog: str) -> list[str]:
    """Make all tables and views of a catalog known to SQL as temporary views; their names. A view may use others, whatever their order."""
    names = tables(spark, catalog)
    for name in names:
        buckets.read(spark, f"{catalog}/{name}").createOrReplaceTempView(name)
    fs, make = _files(spark, catalog)
    left = [tuple(r) for r in buckets.read(spark, f"{catalog}/{_VIEWS}").orderBy("name").collect()] if fs.exists(make(f"{catalog}/{_VIEWS}")) else []
    while left:
        failed, error = [], None
        for name, sql in left:
            try:
                made: DataFrame = spark.sql(sql)
            except Exception as e:  # noqa: BLE001  it may use a view that comes later
                failed.append((name, sql))
                error = e
                continue
            made.createOrReplaceTempView(name)
            names.append(name)
        if len(failed) == len(left):
            raise error
        left = failed
    return names
