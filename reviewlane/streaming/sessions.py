"""Session windows over events, the same for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlane.sources.tables import table

GAP = "6 hours"


def sessions(events: DataFrame, gap: str = GAP, late: str | None = None) -> DataFrame:
    """user_id, n, first, last of each run of events less than `gap` apart.

    late: how long a stream waits for late events; a session is complete once the watermark passes its end.
    """
    timed = events.withWatermark("ts", late) if late else events
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    ).drop("session_window")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    return found.select("user_id", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


SESSIONS_SQL = """
    WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
    SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM g GROUP BY user_id, g"""
