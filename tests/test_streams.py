"""Streams: state that doesn't depend on how events fall into batches."""

import datetime
import random

import numpy as np
import pytest
from finspan.sources import buckets
from finspan.streaming import events as E

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, value double"
START = datetime.datetime(2024, 1, 1)


def events(n=120):
    r = random.Random(5)
    return [(i, START + datetime.timedelta(minutes=r.randrange(2000), microseconds=r.randrange(3)), r.randrange(4), float(r.randrange(6))) for i in range(n)]


def plain(rows, late):
    """Runs of what is more than `late` before the latest event."""
    ms = lambda t: int(t.timestamp() * 1000)
    end = max(ms(x[1]) for x in rows) - late * 60_000
    out = {}
    for _, ts, user, v in sorted((x for x in rows if ms(x[1]) < end), key=lambda x: (x[1], x[0])):
        last, run = out.get(user, (None, 0))
        if last is not None:
            sign = (v > last) - (v < last)
            run = run + sign if sign and run * sign > 0 else sign
        out[user] = v, run
    return out


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_ordered_runs_in_any_batches(spark, tmp_path, seed):
    rows, late = events(), 3000  # minutes: no event is too late, whatever the batches
    rows.append((999, START + datetime.timedelta(minutes=4000), 9, 1.0))
    first, last = rows[:-1], rows[-1:]
    if seed is None:
        first.sort(key=lambda x: x[1])
    else:
        random.Random(seed).shuffle(first)
    for k in range(4):
        part = first[k * 30 : (k + 1) * 30] if k < 3 else first[90:] + last
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "false")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet")
    E.upsert_stream(E.ordered_runs(stream, f"{late} minutes"), f"{tmp_path}/table", f"{tmp_path}/checkpoint", ["user_id"])
    got = {r.user_id: (r.last_value, r.run) for r in buckets.read(spark, f"{tmp_path}/table").collect()}
    assert got == plain(rows, late) and len(got) == 4
    E.upsert_stream(E.ordered_runs(stream, f"{late} minutes"), f"{tmp_path}/table", f"{tmp_path}/checkpoint", ["user_id"])  # goes on, with nothing new
    assert {r.user_id: (r.last_value, r.run) for r in buckets.read(spark, f"{tmp_path}/table").collect()} == got


def test_state_of_ordered_runs_is_shared_by_users(spark, tmp_path):
    """The calls of Python are as many as the groups with events, not as the users."""
    n = 3 * 1024
    rows = [(i, START + datetime.timedelta(minutes=i % 7), i % n, float(i)) for i in range(2 * n)] + [(-1, START + datetime.timedelta(days=9), 0, 1.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events.parquet")
    q = E.ordered_runs(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    q = q.foreachBatch(lambda df, i: df.write.parquet(f"{tmp_path}/out/{i}")).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= E.GROUPS
    got = {r.user_id: (r.last_value, r.run) for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    assert got == plain(rows, 1440) and len(got) == n


def test_runs_go_on_from_batch_to_batch():
    r = random.Random(3)
    rows = [(r.randrange(5), i, i, float(r.randrange(3))) for i in range(200)]
    known, at = np.zeros(0, E._RUN), 0
    while at < len(rows):
        n = r.randrange(1, 12)
        due = np.array(sorted(rows[at : at + n]), E._EVENT)
        at += n
        found, end = E._go_on(known, due)
        assert (due["user_id"][end] == found["user_id"]).all()
        known = np.sort(np.concatenate([known[~np.isin(known["user_id"], found["user_id"])], found]), order="user_id")
        want = {}
        for user, _, _, v in rows[:at]:
            last, run = want.get(user, (None, 0))
            sign = 0 if last is None else (v > last) - (v < last)
            want[user] = v, run + sign if sign and run * sign > 0 else sign
        assert {int(x["user_id"]): (x["last_value"], x["run"]) for x in known} == want
