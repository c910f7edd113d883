"""Clustering against sequential scans and plain average linkage."""

import random

import numpy as np
import pytest
from finspan.operators import clustering as C
from pyspark.sql import functions as F


def scan(nodes, edges):
    near, leader = {}, {}
    for block, a, b in edges:
        near.setdefault((block, a), []).append(b)
    for block, k in sorted(nodes):
        if (block, k) not in leader:
            leader[block, k] = k
            for b in near.get((block, k), ()):
                leader.setdefault((block, b), k)
    return sorted((k, v) for (_, k), v in leader.items())


@pytest.mark.parametrize("shape", ["random", "path", "star", "none", "complete"])
def test_leaders(spark, shape):
    r = random.Random(shape)
    nodes = [(b, 100 * b + i) for b in range(3) for i in range(40)]
    ends = {
        "random": lambda b: [(r.randrange(40), r.randrange(40)) for _ in range(50)],
        "path": lambda b: [(i, i + 1) for i in range(39)],
        "star": lambda b: [(20, i) for i in range(40)],
        "none": lambda b: [],
        "complete": lambda b: [(i, j) for i in range(40) for j in range(i)],
    }[shape]
    edges = [(b, 100 * b + min(x), 100 * b + max(x)) for b in range(3) for x in ends(b) if x[0] != x[1]]
    r.shuffle(edges)
    n = spark.createDataFrame(nodes, "block int, key int").repartition(3)
    e = spark.createDataFrame(edges + edges[:5], "block int, a int, b int").repartition(3)
    if shape == "path":  # the most rounds that a number of nodes can take
        n, e, nodes, edges = n.where("block = 0 and key < 14"), e.where("block = 0 and b < 14"), [x for x in nodes if x[1] < 14], [x for x in edges if x[2] < 14]
    assert sorted(map(tuple, C.leader_groups(n, e).collect())) == scan(nodes, edges)


def test_no_nodes(spark):
    assert C.leader_groups(spark.createDataFrame([], "block int, key int"), spark.createDataFrame([], "block int, a int, b int")).collect() == []


def plain_linkage(d, k):
    """Merge the two clusters with the least mean distance of members until k are left."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        far = {(i, j): np.mean([d[a, b] for a in groups[i] for b in groups[j]]) for i in range(len(groups)) for j in range(i)}
        i, j = min(far, key=far.get)
        groups[j] = sorted(groups[i] + groups[j])
        del groups[i]
    out = np.zeros(len(d), int)
    for n, g in enumerate(sorted(groups), 1):
        out[g] = n
    return out


@pytest.mark.parametrize("n", [2, 3, 7, 25, 60])
def test_linkage(n):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        d = C.correlation_distance(rng.normal(size=(n, 9)))
        assert np.allclose(d, 1 - np.abs(np.corrcoef(np.random.default_rng(seed).normal(size=(n, 9)))))
        found = C.merges(d)
        for k in {1, 2, C.clusters_of(n), n}:
            assert C.cut(n, found, k).tolist() == plain_linkage(d, k).tolist()


def test_copies_and_constants():
    d = C.correlation_distance(np.array([[1, 2, 3], [2, 4, 6], [3, 2, 1], [5, 5, 5], [7, 7, 7.0]]))
    assert d[0, 1] == d[0, 2] == 0 and d[0, 3] == d[3, 4] == 1
    assert C.cut(5, C.merges(d), 3).tolist() == [1, 1, 1, 2, 3]


def frame(spark, groups):
    rows = [(g, f"{g}{i:03d}", v.tolist()) for g, m in groups.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "g string, k string, v array<double>").repartition(3)


def test_groups_and_representatives(spark):
    groups = {"a": np.random.default_rng(1).normal(size=(31, 6)), "b": np.random.default_rng(2).normal(size=(4, 3)), "c": np.ones((1, 2))}
    df = frame(spark, groups)
    c = C.average_linkage(df, "g", "k", "v").join(df.select("k", "v"), "k")
    rows = {(r.g, r.k): r.cluster for r in c.collect()}
    best = {}
    for g, m in groups.items():
        labels = plain_linkage(C.correlation_distance(m), C.clusters_of(len(m)))
        assert [rows[g, f"{g}{i:03d}"] for i in range(len(m))] == labels.tolist()
        for n in set(labels.tolist()):
            at = np.flatnonzero(labels == n)
            far = ((m[at] - m[at].mean(0)) ** 2).sum(1)
            best[g, n] = (f"{g}{at[np.argmin(np.round(far, 9))]:03d}", len(at))
    got = C.representatives(c, "g", "k", "v", F.lit("x")).collect()
    assert {(r.g, r.cluster): (r.k, r.n) for r in got} == best
    assert sorted((r.g, r.cluster, r.name) for r in got if r.g == "b") == [("b", 1, "x"), ("b", 2, "x #2")]


def test_large_groups_raise(spark):
    with pytest.raises(Exception, match="has 5 members, over 4"):
        C.average_linkage(frame(spark, {"a": np.eye(5)}), "g", "k", "v", most=4).collect()
