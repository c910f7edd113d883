"""Similarity of vectors: a stated set of queries against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries, and of one of the searched table: the memory of a task.
QUERY_BLOCK, ROW_BLOCK = 512, 4096


def _blocks(df: DataFrame, n: int, name: str) -> DataFrame:
    """Rows of about n keys and vectors each, dealt by hash."""
    many = max(1, -(-df.count() // n))
    g = df.groupBy(F.pmod(F.xxhash64("key"), F.lit(many)).alias("__b")).agg(F.collect_list(F.struct("key", "vector")).alias(name))
    return g.drop("__b")


def _unit(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _against(queries: DataFrame, rows: DataFrame, found: Callable[[list, list, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """found(keys of queries, keys of rows, cosines) for each pair of blocks. queries, rows: (key, vector); null vectors go."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for q, r in zip(part["q"], part["r"], strict=True):
                yield found([x["key"] for x in q], [x["key"] for x in r], _unit([x["vector"] for x in q]) @ _unit([x["vector"] for x in r]).T)

    known = F.col("vector").isNotNull()
    q, r = _blocks(queries.where(known), QUERY_BLOCK, "q"), _blocks(rows.where(known), ROW_BLOCK, "r")
    return q.hint("shuffle_replicate_nl").crossJoin(r).mapInPandas(run, schema)  # blocks, not rows


def search(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(a, b, score): each query with every other row whose cosine with it is at least so much."""

    def found(a: list, b: list, cos: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(cos >= least)
        a, b = np.array(a)[i], np.array(b)[j]
        other = a != b
        return pd.DataFrame({"a": a[other], "b": b[other], "score": cos[i, j][other]})

    t = queries.schema["key"].dataType.simpleString()
    return _against(queries, rows, found, f"a {t}, b {t}, score double")


def uniqueness(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, uniqueness): one less the mean absolute cosine of each query with all other rows."""

    def found(a: list, b: list, cos: np.ndarray) -> pd.DataFrame:
        other = np.array(a)[:, None] != np.array(b)[None, :]
        return pd.DataFrame({"key": a, "total": (np.abs(cos) * other).sum(1), "n": other.sum(1)})

    t = queries.schema["key"].dataType.simpleString()
    g = _against(queries, rows, found, f"key {t}, total double, n long").groupBy("key")
    return g.agg((1 - F.try_divide(F.sum("total"), F.sum("n"))).alias("uniqueness"))
