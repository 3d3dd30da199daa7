"""Streams, and what a stream leaves behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import EVENT_LINE_SQL, event_line, read
from ..streaming import events as E
from .registry import query

def _stream(spark, d):
    return E.source(spark, f"{d}/events.parque[t]", read(spark, d, "events").schema)


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(spark, d):
    """Extension: daily windows over the event stream, complete."""
    return E.finished(E.tumbling(_stream(spark, d), "1 day", "1 hour"))


@query("""WITH w AS (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_windows(spark, d):
    """Extension: days that begin every twelve hours, over the stream."""
    return E.finished(E.sliding(_stream(spark, d), "1 day", "12 hours", "1 hour"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Extension: sessions by user without a pause of six hours, over the stream."""
    return E.finished(E.sessions(_stream(spark, d).withWatermark("ts", "1 hour"), "6 hours"))


_TEMPLATE = "regexp_replace(regexp_replace(regexp_replace(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[0-9]{2}:[0-9]{2}:[0-9]{2}', '<time>', 'g'), '=[0-9]+', '=<n>', 'g')"


@query(f"""WITH l AS (SELECT event_id, event_type, {EVENT_LINE_SQL} AS line FROM events)
  SELECT {_TEMPLATE} AS key, count(*) AS n, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS rank, arg_min(line, event_id) AS sample, min(event_id) AS first_seen, max(event_id) AS last_seen FROM l GROUP BY key, event_type""")
def tail_stream(spark, d):
    """A followed log, reduced: each template's lines, worst severity with its first line, first and last place."""
    rows = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("line", event_line())
    return E.finished(E.reduce_log(rows, F.col("line"), "event_id"))


@query("""WITH x AS (SELECT event_id, (SELECT max(ts) FROM events) - ts AS age FROM events) SELECT event_id, CASE WHEN age <= INTERVAL 60 SECONDS THEN 'fresh' WHEN age <= INTERVAL 300 SECONDS THEN 'stale' ELSE 'expired' END AS state FROM x""")
def cache_freshness(spark, d):
    """What may still be used of cached rows, by their age before the newest."""
    rows = read(spark, d, "events")
    return rows.join(F.broadcast(rows.agg(F.max("ts").alias("now")))).select("event_id", E.freshness(F.col("ts"), F.col("now")).alias("state"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  r AS (SELECT user_id, event_id, k, ts AS last, true AS emitted FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.ts - r.last >= INTERVAL '1 day' THEN e.ts ELSE r.last END, e.ts - r.last >= INTERVAL '1 day' FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
  SELECT user_id, event_id FROM r WHERE emitted""")
def ttl_dedupe(spark, d):
    """Events of users that were last let through a day ago or more."""
    return E.expire(read(spark, d, "events"), "user_id", "ts", 86400.0, ["event_id"]).select("user_id", "event_id")
