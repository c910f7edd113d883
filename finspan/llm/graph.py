"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finspan.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.union(others)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    edges: two columns of whole numbers; loops and repeated edges do no harm. Rows with a null are dropped.
    """
    now = edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = written(now, "edges"), None
    while True:
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(a, b) as decimal(20, 0)))").alias("h")).first()
        if mark == before:
            return now.toDF("node", "component")
        before = mark
