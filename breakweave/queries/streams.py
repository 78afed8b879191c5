"""X: streams over the events table, read as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..streaming import streams as s
from . import query

c = F.col


def events(fx: Fixtures) -> DataFrame:
    """The events as a stream of files, in one folder or one file."""
    schema = fx.table("events").schema
    stream = fx.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{fx.sf_dir}/events.parque[t]")
    return stream.withColumn("ts", c("ts").cast("timestamp"))


def text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("x1", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events
 WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""")
def x1(fx: Fixtures) -> DataFrame:
    """Events of each type in hourly windows that are final."""
    return s.run_to_table(s.stream_run_counts(events(fx)), "x1").select(text("window_start"), "event_type", "n")


@query("x2", """WITH g AS (SELECT *, coalesce((ts >= lag(ts) OVER w + INTERVAL 30 MINUTE)::INT, 0) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS z, count(*) AS n FROM k GROUP BY user_id, k)
 SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(z, '%Y-%m-%d %H:%M:%S') AS end_ts, n FROM x WHERE z <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def x2(fx: Fixtures) -> DataFrame:
    """Sessions of each user that are final."""
    return s.run_to_table(s.stream_gap_groups(events(fx)), "x2").select("user_id", text("first_ts"), text("end_ts"), "n")


@query("x3", "SELECT user_id, event_type, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY ALL")
def x3(fx: Fixtures) -> DataFrame:
    """Users and types, each once an hour."""
    out = s.run_to_table(s.stream_dedup_spans(events(fx), ["user_id", "event_type"]), "x3")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("x4", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, user_id % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def x4(fx: Fixtures) -> DataFrame:
    """Counts by day, type and key, upserted."""
    stream = s.stream_counts(events(fx).withColumn("k", c("user_id") % 10), ["event_type", "k"])
    found = s.run_with_upserts(stream, "x4", ["window_start", "event_type", "k"])
    return found.select(text("window_start"), "event_type", "k", "n")
