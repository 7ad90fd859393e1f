"""The batch plans of the streaming operators over the event table; streaming runs are tested on file streams."""

from pyspark.sql import functions as F

from tidewright.plans.registry import query
from tidewright.streaming import streams


def _stats_sql(size, starts):
    return f"""WITH w AS (SELECT event_type, value, {starts} AS start FROM events)
SELECT event_type, start, start + INTERVAL '{size}' AS "end", count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM w GROUP BY 1, 2, 3"""


def _plain(df):
    return df.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "mean": F.round("mean", 6)})


@query("tumbling_stats", _stats_sql("6 hours", "time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')"))
def tumbling_stats(t):
    return _plain(streams.windowed_stats(t.events, "event_type", "value", "6 hours"))


@query(
    "sliding_stats",
    _stats_sql("6 hours", "unnest([time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours'])"),
)
def sliding_stats(t):
    return _plain(streams.windowed_stats(t.events, "event_type", "value", "6 hours", "3 hours"))


@query(
    "sensor_sessions",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n_events FROM r GROUP BY user_id, run""",
)
def sensor_sessions(t):
    out = streams.sensor_sessions(t.events, "user_id", gap="2 hours")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "last": F.col("last").cast("timestamp_ntz")})


@query("replayed_rows", "SELECT c_custkey, CAST(e AS INT) AS epoch FROM customer, range(0, 3) r(e)")
def replayed_rows(t):
    return streams.replay(t.customer.select("c_custkey"), 3)
