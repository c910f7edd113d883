"""Clustering of assets: leaders by rounds of local minima, average linkage inside groups, and the representatives of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finspan.sources.sinks import written

#: Members of a group at most: a group's distances are a matrix in one task.
MOST = 4_000


def leader_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, leader): in ascending order of key, a node to which no earlier leader has an edge leads; others join their first leader.

    nodes: (block, key), distinct; edges: (block, a, b) with a < b. Nothing is scanned in order: in each round, every node without a smaller
    neighbour that is still open leads, and its neighbours are closed; the leaders are those of the sequential scan, whatever the order of
    rows. A round is joins on (block, key); rounds grow with the longest ascending path of open nodes, in practice with the logarithm of the nodes.
    """
    pairs = written(edges.select("block", "a", "b").distinct(), "leader-edges")
    left, links = written(nodes.select("block", "key"), "leader-open"), pairs
    leaders = None
    while not left.isEmpty():
        new = written(left.join(links.select("block", F.col("b").alias("key")), ["block", "key"], "left_anti"), "leaders")
        leaders = new if leaders is None else leaders.unionByName(new)
        closed = links.join(new.withColumnRenamed("key", "a"), ["block", "a"]).select("block", F.col("b").alias("key"))
        left = written(left.join(new, ["block", "key"], "left_anti").join(closed, ["block", "key"], "left_anti"), "leader-open")
        for end in ("a", "b"):
            links = links.join(left.withColumnRenamed("key", end), ["block", end], "left_semi")
        links = written(links, "leader-links")
    if leaders is None:
        return nodes.select("key", F.col("key").alias("leader")).limit(0)
    first = pairs.join(leaders.withColumnRenamed("key", "a"), ["block", "a"]).groupBy("block", F.col("b").alias("key")).agg(F.min("a").alias("leader"))
    follow = first.join(leaders, ["block", "key"], "left_anti").select("key", "leader")
    return leaders.select("key", F.col("key").alias("leader")).unionByName(follow)


def correlation_distance(m: np.ndarray) -> np.ndarray:
    """1 - |Pearson correlation| of rows; undefined correlations count as none. Rounded, so that equal distances tie."""
    z = m - m.mean(1, keepdims=True)
    size = np.sqrt((z**2).sum(1))
    z /= np.where(size > 1e-12, size, np.inf)[:, None]
    d = np.round(1 - np.abs(np.clip(z @ z.T, -1, 1)), 12)
    np.fill_diagonal(d, 0)
    return d


def merges(d: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges of average linkage, by nearest-neighbour chains; a < b are members of the merged clusters.

    Distances of a merged cluster follow from those of its parts (Lance and Williams), weighted by their sizes.
    """
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, out = np.ones(n), np.ones(n, bool), [], []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        here = chain[-1]
        near = int(np.argmin(d[here]))
        if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
            near = chain[-2]  # of equal distances the one that the chain came from, so that it ends
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        del chain[-2:]
        a, b = min(here, near), max(here, near)
        out.append((float(d[a, b]), a, b))
        d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    return out


def cut(n: int, found: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Cluster numbers from 1, in the order of their first members, after all but the k - 1 highest merges."""
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(found, key=lambda x: x[0])[: max(0, n - k)]:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    number: dict[int, int] = {}
    return np.array([number.setdefault(top(i), len(number) + 1) for i in range(n)])


def clusters_of(n: int) -> int:
    """How many clusters a group of n gets: a fifth of its members, from 2 to 10."""
    return min(max(2, n // 5), 10, n)


def average_linkage(df: DataFrame, group: str, key: str, vector: str, most: int = MOST) -> DataFrame:
    """(group, key, cluster): average linkage on 1 - |correlation| inside each group, cut by the group's size; clusters are numbered by their least keys.

    vector: arrays of one length in a group, without nulls. A group is a matrix in one task: groups of more than `most` raise.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (group, key)}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > most:
            raise ValueError(f"group {part[group].iloc[0]!r} has {len(part)} members, over {most}")
        part = part.sort_values(key, ignore_index=True)
        n = len(part)
        found = merges(correlation_distance(np.array(part[vector].tolist(), float))) if n > 1 else []
        return pd.DataFrame({group: part[group], key: part[key], "cluster": cut(n, found, clusters_of(n))})

    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster int")


def representatives(df: DataFrame, group: str, key: str, vector: str, name: Column) -> DataFrame:
    """(group, cluster, key, name, n): of each cluster of df (group, key, cluster, vector) the member nearest to its mean, of equal ones the first.

    Later clusters of a group whose representatives have one name get #2, #3, ...
    """
    long = df.select(group, "cluster", key, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(group, "cluster", "i").agg(F.avg("x").alias("mean"))
    far = long.join(mean, [group, "cluster", "i"]).groupBy(group, "cluster", key).agg(F.round(F.sum(F.pow(F.col("x") - F.col("mean"), F.lit(2))), 9).alias("far"))
    best = far.groupBy(group, "cluster").agg(F.min(F.struct("far", key)).alias("best"), F.count("*").alias("n")).select(group, "cluster", F.col(f"best.{key}").alias(key), "n")
    nth = F.row_number().over(Window.partitionBy(group, "__name").orderBy("cluster"))
    best = best.withColumn("__name", name).withColumn("__nth", nth)
    return best.select(group, "cluster", key, F.when(F.col("__nth") > 1, F.concat("__name", F.lit(" #"), "__nth")).otherwise(F.col("__name")).alias("name"), "n")
