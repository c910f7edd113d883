"""Writers that can be run again without harm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in the checkpoint folder that the session names, else in the warehouse; all executors share both."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.finspan"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to a new shared folder and read back: what follows starts from there, also after an executor is lost."""
    path = shared_folder(df.sparkSession, what)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of old and new; of equal keys those of new, of several the first by order (else by the other columns, descending)."""
    both = old.withColumn("__g", F.lit(0)).unionByName(new.withColumn("__g", F.lit(1)), allowMissingColumns=True)
    order = order or [F.desc(c) for c in both.columns if c not in (*keys, "__g")]
    return both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__g"), *order))).where("__k = 1").drop("__g", "__k")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; a replacement that was broken off is taken back first."""
    fs, make = _files(spark, path)
    before = f"{path.rstrip('/')}.before"
    if not fs.exists(make(path)) and fs.exists(make(before)):
        fs.rename(make(before), make(path))
    return fs.exists(make(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that upsert has written; also after an upsert that was broken off."""
    _exists(spark, path)
    return spark.read.parquet(path)


def upsert(new: DataFrame, path: str, keys: list[str], order: list | None = None) -> None:
    """Put new over the Parquet table at path.

    The merged table is written beside it; the old one is moved aside, the merged one into its place, and then the old
    one goes. At each point one of them is whole, and the next call or read goes on from it.
    """
    spark = new.sparkSession
    old = spark.read.parquet(path) if _exists(spark, path) else new.limit(0)
    stage, before = f"{path.rstrip('/')}-{uuid.uuid4().hex}", f"{path.rstrip('/')}.before"
    upserted(old, new, keys, order).write.parquet(stage)
    fs, make = _files(spark, path)
    fs.delete(make(before), True)
    if fs.exists(make(path)) and not fs.rename(make(path), make(before)) or not fs.rename(make(stage), make(path)):
        raise OSError(f"could not move {stage} to {path}")
    fs.delete(make(before), True)


def retained(rows: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last days, counted back from the latest row."""
    last = rows.agg(F.max(time).alias("__last"))
    return rows.join(F.broadcast(last), F.col(time) > F.col("__last") - F.make_dt_interval(F.lit(days))).drop("__last")  # one row


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only those partitions of the table that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table does not have."""
    spark = new.sparkSession
    rows = new.dropDuplicates(keys)
    if _exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
