"""Event streams: windowed flash figures, deduplication, upserts and state by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from finspan.sources import buckets, sinks


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A file of a folder, or the files of a folder of that name inside it, as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    fs, make = sinks._files(spark, folder)
    files = spark.readStream.schema(schema)
    inside = fs.getFileStatus(make(f"{folder}/{pattern}")).isDirectory()
    files = files.parquet(f"{folder}/{pattern}") if inside else files.option("pathGlobFilter", pattern).parquet(folder)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def flash(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def distinct_events(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Each event once, remembered as long as the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def runs(events: DataFrame) -> DataFrame:
    """(user_id, last_value, run): after each batch, a user's last value and the signed length of its run of rises or falls."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            if last is not None:
                sign = (v > last) - (v < last)
                run = run + sign if sign and run * sign > 0 else sign
            last = v
        state.update((float(last), int(run)))
        yield pd.DataFrame({"user_id": [key[0]], "last_value": [float(last)], "run": [int(run)]})

    out, kept = "user_id bigint, last_value double, run int", "last_value double, run int"
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


#: Groups of users whose state is kept together, so that the work of a call is shared by many. Choose so that a group of all users' waiting events fits a task.
GROUPS = 1024
_EVENT = np.dtype([("user_id", "i8"), ("us", "i8"), ("event_id", "i8"), ("value", "f8")])
_RUN = np.dtype([("user_id", "i8"), ("last_value", "f8"), ("run", "i4")])


def _go_on(known: np.ndarray, due: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The users of due with their last values and runs after its events, which are in order by user; and the place of each one's last event.

    known: the last values and runs before, by user in order.
    """
    n = len(due)
    new = np.append(True, due["user_id"][1:] != due["user_id"][:-1])
    begin, end = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
    users = due["user_id"][begin]
    last, run = np.full(len(users), np.nan), np.zeros(len(users), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known["user_id"], users), len(known) - 1)
        had = known["user_id"][at] == users
        last[had], run[had] = known["last_value"][at[had]], known["run"][at[had]]
    v = due["value"]
    before = np.append(np.nan, v[:-1])
    before[begin] = last
    sign = (v > before).astype(np.int64) - (v < before)
    streak = np.maximum.accumulate(np.where(new | np.append(True, sign[1:] != sign[:-1]), np.arange(n), 0))[end]
    s = sign[end]
    out = np.empty(len(users), _RUN)
    out["user_id"], out["last_value"] = users, v[end]
    out["run"] = s * (end - streak + 1) + np.where((streak == begin) & (run * s > 0), run, 0)
    return out, end


def ordered_runs(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(user_id, last_value, run, settled): like runs, of the events that the watermark has passed, in the order of their times and ids.

    Events up to `late` behind the latest one may come in any batch; the result is the same. settled is the time of the last event counted, in
    microseconds. Null users, times, ids and values are left out. The session's state store becomes RocksDB, which keeps state on disk.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events.withWatermark("ts", late).where("user_id is not null and ts is not null and event_id is not null and value is not null")
    e = e.select(F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).alias("users"), "ts", "user_id", F.unix_micros("ts").alias("us"), "event_id", "value")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State of a group of users: the events that wait, and the last values and runs of those that counted. It times out once the watermark is past the first that waits."""
        waiting, known = (np.frombuffer(x, t) for x, t in zip(state.get if state.exists else (b"", b""), (_EVENT, _RUN), strict=True))
        rows = [waiting]
        for part in parts if not state.hasTimedOut else ():
            rows.append(np.empty(len(part), _EVENT))
            for c in _EVENT.names:
                rows[-1][c] = part[c]
        rows = np.concatenate(rows)
        is_due = rows["us"] // 1000 < state.getCurrentWatermarkMs()
        due, waiting = rows[is_due], rows[~is_due]
        if len(due):
            due = due[np.lexsort((due["event_id"], due["us"], due["user_id"]))]
            found, end = _go_on(known, due)
            known = np.concatenate([known[~np.isin(known["user_id"], found["user_id"])], found])
            known = known[np.argsort(known["user_id"])]
        state.update((waiting.tobytes(), known.tobytes()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting["us"].min()) // 1000, 1))
        if len(due):
            yield pd.DataFrame({c: found[c] for c in _RUN.names} | {"settled": due["us"][end]})

    out = "user_id bigint, last_value double, run int, settled bigint"
    return e.groupBy("users").applyInPandasWithState(step, out, "waiting binary, known binary", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(events: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "update") -> None:
    """Merge each batch into the buckets of the table at path by key, until what is there has been read; a batch that is sent again changes nothing."""
    q = events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.foreachBatch(lambda df, n: buckets.upsert(df, path, keys, batch=(checkpoint, n))).start().awaitTermination()
