"""Series, interval and log shapes derived from the given tables, in Spark and in the same SQL."""

from pyspark.sql import functions as F

from tidewright.operators import series
from tidewright.session import durable

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def hours(ts="ts"):
    """Whole hours since the first day of the event log."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})") / F.lit(3_600_000_000)).cast("bigint")


def seconds(ts="ts"):
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})") / F.lit(1_000_000)).cast("bigint")


def hourly_gaps(t):
    """Mean event value per type and hour on a full grid; hours without events are NULL."""
    obs = (
        t.events.select(F.col("event_type").alias("series_id"), hours().alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
        .groupBy("series_id", "t")
        .agg((F.sum("c") / F.count("*") / 100.0).alias("value"))
    )
    return series.on_full_grid(obs, ["series_id"])


def hourly(t):
    """The hourly series with gaps filled and the step counted from 0."""
    filled = series.interpolate(hourly_gaps(t), ["series_id"])
    first = filled.groupBy("series_id").agg(F.min("t").alias("_t0"))
    moved = filled.join(first, "series_id").select("series_id", (F.col("t") - F.col("_t0")).alias("t"), F.col("filled").alias("value"))
    return durable(moved)  # every series query reads this base several times


HOURLY_GAPS_SQL = """
obs AS (
  SELECT event_type AS series_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) - 473352 AS t,
         sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100.0 AS value
  FROM events GROUP BY 1, 2),
span AS (SELECT series_id, min(t) AS lo, max(t) AS hi FROM obs GROUP BY 1),
grid AS (SELECT series_id, unnest(range(lo, hi + 1)) AS t FROM span),
gaps AS (SELECT g.series_id, g.t, o.value FROM grid g LEFT JOIN obs o ON o.series_id = g.series_id AND o.t = g.t)
"""

HOURLY_SQL = HOURLY_GAPS_SQL + """,
marks AS (
  SELECT series_id, t, value,
    last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta,
    last_value(value IGNORE NULLS) OVER b AS va,
    first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a AS tb,
    first_value(value IGNORE NULLS) OVER a AS vb
  FROM gaps
  WINDOW b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT series_id, t, value AS raw,
    CASE WHEN value IS NOT NULL THEN value
         WHEN ta IS NOT NULL AND tb IS NOT NULL THEN va + (vb - va) * ((t - ta)::DOUBLE / (tb - ta))
         ELSE coalesce(va, vb) END AS value
  FROM marks),
hourly AS (
  SELECT series_id, t - min(t) OVER (PARTITION BY series_id) AS t, value FROM filled)
"""


def daily_by_segment(t):
    """Order totals per market segment and day, as integer cents."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")
    orders = t.orders.select("o_custkey", day.alias("t"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    joined = orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("series_id"), "t").agg((F.sum("c") / 100.0).alias("value"))


DAILY_SQL = """
daily AS (
  SELECT c_mktsegment AS series_id, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / 100.0 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""
