"""Work on rows that can be broken off and resumed: what is done is in a ledger, a table merged by bucket, failures included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finspan.sources import buckets as B
from finspan.sources.sinks import shared_folder

ERROR = "error"


def resume(rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, buckets: int = B.BUCKETS, retry: bool = False, most: int | None = None) -> int:
    """Do the work on those of rows (distinct keys) that the ledger at path doesn't have; how many parts are left.

    A part is a bucket of the ledger: its results are committed at once, in that bucket alone, before the next one begins. A run that breaks
    off loses the part that it was at; the next one goes on from there. work gives key, its results and `error`, null where it went well;
    failed rows are done too, unless retry asks for them again. most: parts of this run. Null keys are left out.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(key).isNotNull())
    n = B.version(spark, path).buckets if B.version(spark, path).number else buckets
    if B.version(spark, path).number:
        done = B.read(spark, path)
        rows = rows.join((done.where(F.col(ERROR).isNull()) if retry else done).select(key), key, "left_anti")
    left, schema = shared_folder(spark, "ledger-left"), rows.schema
    dealt = rows.withColumn("__part", B._bucket([key], n))
    dealt.repartition("__part").write.partitionBy("__part").parquet(left)
    parts = [int(x.removeprefix("__part=")) for x in B._names(spark, left) if x.startswith("__part=")]  # the ledger's buckets at most
    for part in parts[:most]:
        B.upsert(work(spark.read.schema(schema).parquet(f"{left}/__part={part}")), path, [key], buckets=n)
    return len(parts[most:]) if most is not None else 0
