"""Queries that run a stream over the events to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finspan.sources import buckets
from finspan.sources.sinks import shared_folder
from finspan.streaming import events as E


def _run(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    E.upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint", keys, mode)
    return buckets.read(spark, f"{folder}/table")


def stream_flash(spark: SparkSession, sf: str) -> DataFrame:
    return _run(E.flash(E.read(spark, sf), late="60 days"), ["start", "event_type"]).withColumn("value", F.round("value", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _run(E.runs(E.read(spark, sf)), ["user_id"])


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a stream that sends each of them twice, once each."""
    e = E.read(spark, sf)
    once = E.distinct_events(e.union(e), late="60 days").select("event_id", "user_id", "event_type")
    return _run(once, ["event_id"], "append")


def stream_ordered_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the events up to a day before the latest one, in the order of their times."""
    return _run(E.ordered_runs(E.read(spark, sf)), ["user_id"]).drop("settled")


_RUNS = """WITH e AS (SELECT user_id, value, row_number() OVER w AS k, sign(value - lag(value) OVER w) AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS back, first_value(s) OVER (PARTITION BY user_id ORDER BY k DESC) AS last_s FROM e),
r AS (SELECT user_id, max(CASE WHEN back = 1 THEN value END) AS last_value, coalesce(min(CASE WHEN s IS DISTINCT FROM last_s THEN back END) - 1, count(*)) AS n, max(last_s) AS s FROM g GROUP BY 1)
SELECT user_id, last_value, CAST(coalesce(CASE WHEN s = 0 THEN 0 ELSE s * n END, 0) AS INTEGER) AS run FROM r"""
QUERIES = {"stream_ordered_runs": stream_ordered_runs, "stream_flash": stream_flash, "stream_runs": stream_runs, "stream_dedup": stream_dedup}
ORACLES = {
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_flash": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stream_runs": _RUNS.format(events="events"),
    "stream_ordered_runs": _RUNS.format(events="(SELECT * FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 86400000 FROM events)) e"),
}
