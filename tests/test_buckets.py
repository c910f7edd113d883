"""Tables merged by bucket: what is rewritten, what counts after a break, and that repeated batches change nothing."""

import datetime
import glob
import os
import random

import pytest
from finspan.sources import buckets as B
from pyspark.sql import functions as F

SCHEMA = "k bigint, v string, n int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def table(spark, path, number=None):
    return sorted((tuple(r) for r in B.read(spark, path, number).collect()), key=str)


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/*/*/*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(i, f"v{i}", i) for i in range(500)]
    assert B.upsert(frame(spark, rows), path, ["k"], buckets=16) == list(range(16))
    before, v1 = files(path), B.version(spark, path)
    assert len(before) == 16  # a file for each
    touched = B.upsert(frame(spark, [(3, "new", 0), (1000, "more", 1), (3, "newer", -5)]), path, ["k"])
    assert 1 <= len(touched) <= 2
    after, v2 = files(path), B.version(spark, path)
    assert len(set(after) - set(before)) == len(touched) and all(after[f] == before[f] for f in before)
    assert {b for b in v1.data if v1.data[b] != v2.data[b]} == set(map(str, touched))
    want = sorted([(3, "newer", -5) if k == 3 else (k, v, n) for k, v, n in rows] + [(1000, "more", 1)], key=str)
    assert table(spark, path) == want and table(spark, path, 1) == sorted(rows, key=str)
    assert B.upsert(frame(spark, []), path, ["k"]) == [] and B.version(spark, path).number == 2
    assert B.vacuum(spark, path, keep=1) == 0 and len(files(path)) == 16 + len(touched)  # the first folder still has buckets that count
    assert table(spark, path) == want


def test_same_as_a_dictionary(spark, tmp_path):
    path, r, want = str(tmp_path / "t"), random.Random(1), {}
    for turn in range(5):
        new = [(r.choice([None, *range(30)]), r.choice(["a", "b", None]), r.choice([None, *range(9)])) for _ in range(40)]
        latest = turn % 2 == 1
        B.upsert(frame(spark, new), path, ["k"], ["n", "v"], latest, buckets=4)
        least = lambda x: (x is not None, x or (0 if not isinstance(x, str) else ""))
        order = lambda row: (least(row[2]), (row[1] is not None, row[1] or ""))
        best = {}
        for row in new:
            if row[0] not in best or order(row) > order(best[row[0]]):
                best[row[0]] = row
        for k, row in best.items():
            if not latest or k not in want or order(row) >= order(want[k]):
                want[k] = row
        assert table(spark, path) == sorted(want.values(), key=str)


def test_a_hot_key_and_keys_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert(spark.range(5000).select(F.lit(1).cast("bigint").alias("k"), F.lit("x").alias("v"), F.col("id").cast("int").alias("n")), path, ["k"])
    assert table(spark, path) == [(1, "x", 4999)]
    B.upsert(frame(spark, [(1, "x", 3), (1, "x", 3)]).select("k", "v"), f"{path}2", ["k", "v"])
    assert table(spark, f"{path}2") == [(1, "x")]


def test_batches_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert(frame(spark, [(1, "a", 1)]), path, ["k"], batch=("s", 0))
    assert B.upsert(frame(spark, [(1, "b", 2)]), path, ["k"], batch=("s", 0)) == [] and table(spark, path) == [(1, "a", 1)]
    B.upsert(frame(spark, [(1, "c", 3)]), path, ["k"], batch=("other", 0))
    assert B.version(spark, path).batches == {"s": 0, "other": 0}
    with pytest.raises(ValueError, match="keys"):
        B.upsert(frame(spark, [(1, "c", 3)]), path, ["v"])
    old = B.version(spark, path, 1)
    with pytest.raises(B.Conflict):
        B._replace(spark, path, old, frame(spark, [(9, "z", 9)]).withColumn("__b", F.lit(0)), [0], None)
    assert table(spark, path) == [(1, "c", 3)]
    with open(f"{path}/_versions/{3:012d}.json", "w") as f:
        f.write('{"number": 3, "ke')  # a writer that broke off
    assert table(spark, path) == [(1, "c", 3)]
    with pytest.raises(FileNotFoundError):
        B.read(spark, f"{path}-none")


def test_delete_and_retain(spark, tmp_path):
    path = str(tmp_path / "t")
    B.upsert(frame(spark, [(i, None if i % 2 else "x", i) for i in range(50)]), path, ["k"], buckets=8)
    touched = B.delete(spark, path, "v = 'x' and n < 4")
    assert 1 <= len(touched) <= 2 and [r[0] for r in sorted(B.read(spark, path).collect())] == [1, 3, *range(4, 50)]
    assert B.delete(spark, path, "n > 100") == []
    B.delete(spark, path, "true")
    assert table(spark, path) == [] and B.version(spark, path).data == {}
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    B.upsert(spark.createDataFrame([(d, day(d)) for d in range(1, 20)], "k int, at timestamp"), f"{path}2", ["k"])
    B.retain(spark, f"{path}2", "at", 7)
    assert [r[0] for r in table(spark, f"{path}2")] == sorted(range(13, 20), key=str)
