"""Sensor-log queries; the motion log, label ranges and part files are derived from the event table."""

from pyspark.sql import functions as F

from tidewright.functions.labels import SCHEMES, choose
from tidewright.operators import intervals
from tidewright.operators.scan import chunk_of
from tidewright.plans.inputs import seconds
from tidewright.plans.registry import query

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
SECONDS_SQL = "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - 1704067200"


def motion(t):
    """Motion log: 30-second frames, one sensor per 40th of the users, the day as part file."""
    return t.events.select(
        F.col("event_id").alias("line_no"),
        (F.col("user_id") % 40).alias("sensor"),
        F.floor(seconds() / 30).cast("bigint").alias("frame"),
        F.floor(seconds() / 86400).cast("bigint").alias("part"),
        F.col("event_type").alias("room"),
        (F.col("value") - 5).alias("x"),
        F.expr(f"CASE WHEN {K} % 3 = 0 THEN 0.0 ELSE {K} END").cast("double").alias("y"),
        F.lit(0.0).alias("z"),
        F.expr(K).alias("k"),
    )


MOTION_SQL = f"""
motion AS (
  SELECT event_id AS line_no, user_id % 40 AS sensor, CAST(floor(({SECONDS_SQL}) / 30) AS BIGINT) AS frame,
         CAST(floor(({SECONDS_SQL}) / 86400) AS BIGINT) AS part, event_type AS room, value - 5 AS x,
         CAST(CASE WHEN {K} % 3 = 0 THEN 0.0 ELSE {K} END AS DOUBLE) AS y, 0.0 AS z, {K} AS k
  FROM events)"""

INTERVAL_SQL = f"""{MOTION_SQL},
lit AS (SELECT DISTINCT sensor, frame FROM motion WHERE sqrt(x * x + y * y + z * z) > 0),
step AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY sensor ORDER BY frame) < 20 THEN 0 ELSE 1 END AS opens FROM lit),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY sensor ORDER BY frame) AS run_id FROM step),
spans AS (SELECT sensor, CAST(run_id AS BIGINT) AS run_id, min(frame) AS start, max(frame) AS last FROM runs GROUP BY 1, 2)"""


@query("sensor_intervals", f"WITH {INTERVAL_SQL} SELECT * FROM spans")
def sensor_intervals(t):
    return intervals.active_intervals(motion(t), ["sensor"])


@query(
    "sensor_transitions",
    f"""WITH {INTERVAL_SQL} SELECT sensor, start AS frame, 'ON' AS state FROM spans
UNION ALL SELECT sensor, last + 1, 'OFF' FROM spans""",
)
def sensor_transitions(t):
    return intervals.transitions(intervals.active_intervals(motion(t), ["sensor"]), ["sensor"])


def label_ranges(t):
    """Label runs per room: alternating two labels by the motion counter, ranges from the frame."""
    return motion(t).select(
        "room", "line_no", F.when(F.col("k") % 4 < 2, "eat").otherwise("work").alias("label"),
        F.col("frame").alias("start"), (F.col("frame") + F.col("k") % 5).alias("end"),
    )


RUN_SQL = f"""{MOTION_SQL},
ranges AS (SELECT room, line_no, CASE WHEN k % 4 < 2 THEN 'eat' ELSE 'work' END AS label, frame AS start, frame + k % 5 AS "end" FROM motion),
flag AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY room ORDER BY line_no) THEN 0 ELSE 1 END AS opens FROM ranges),
runs AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY room ORDER BY line_no) AS BIGINT) AS run_id FROM flag),
merged AS (
  SELECT room, run_id, min_by(label, line_no) AS label, min_by(start, line_no) AS start, max_by("end", line_no) AS "end"
  FROM runs GROUP BY 1, 2)"""


def merged_runs(t):
    return intervals.collapse_runs(label_ranges(t), ["room"], "line_no", "label", chunk_of("line_no", 100_000))


@query("label_runs", f"WITH {RUN_SQL} SELECT * FROM merged")
def label_runs(t):
    return merged_runs(t)


@query(
    "events_in_segments",
    f"""WITH {RUN_SQL} SELECT m.room, run_id, label, line_no, frame FROM motion m
JOIN merged s ON s.room = m.room AND m.frame >= s.start AND m.frame <= s."end" """,
)
def events_in_segments(t):
    points = motion(t).select("room", "line_no", "frame")
    return intervals.interval_join(points, merged_runs(t), ["room"], "frame", width=200).select("room", "run_id", "label", "line_no", "frame")


@query(
    "frame_to_clock",
    f"""WITH {MOTION_SQL},
lines AS (SELECT room, line_no, frame AS start, frame + 3 AS "end",
  lpad(CAST(frame // 120 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(frame // 2 % 60 AS VARCHAR), 2, '0') AS hhmm FROM motion WHERE k % 2 = 0),
asked AS (SELECT DISTINCT room, frame FROM motion)
SELECT a.room, a.frame, min_by(hhmm, line_no) AS hhmm FROM asked a
LEFT JOIN lines l ON l.room = a.room AND a.frame BETWEEN l.start AND l."end" GROUP BY 1, 2""",
)
def frame_to_clock(t):
    base = motion(t)
    two = lambda e: F.lpad(e.cast("string"), 2, "0")
    hour, minute = F.floor(F.col("frame") / 120) % 24, F.floor(F.col("frame") / 2) % 60
    lines = base.where("k % 2 = 0").select(
        "room", "line_no", F.col("frame").alias("start"), (F.col("frame") + 3).alias("end"),
        F.concat(two(hour), F.lit(":"), two(minute)).alias("hhmm"),
    )
    return intervals.first_match(base, lines, ["room"], "frame", width=100)


@query(
    "continued_ranges",
    f"""WITH {MOTION_SQL}, f AS (SELECT room, part, line_no, frame AS start, frame + k % 5 AS "end", min(part) OVER (PARTITION BY room) AS p0 FROM motion),
b AS (SELECT room, max_by("end", line_no) AS base FROM f WHERE part = p0 GROUP BY 1),
r AS (SELECT f.*, base + sum(CASE WHEN part > p0 THEN "end" - start + 1 ELSE 0 END) OVER (PARTITION BY room ORDER BY part, line_no) AS moved
  FROM f JOIN b USING (room))
SELECT room, part, line_no, CAST(CASE WHEN part > p0 THEN moved - ("end" - start) ELSE start END AS BIGINT) AS start,
  CAST(CASE WHEN part > p0 THEN moved ELSE "end" END AS BIGINT) AS "end" FROM r""",
)
def continued_ranges(t):
    lines = motion(t).select("room", "part", "line_no", F.col("frame").alias("start"), (F.col("frame") + F.col("k") % 5).alias("end"))
    return intervals.continue_ranges(lines, "room", chunk_parts=1)


@query(
    "rebased_frames",
    f"""WITH {MOTION_SQL}, p AS (SELECT sensor, part, min_by(frame, line_no) AS base, max(frame) AS top FROM motion GROUP BY 1, 2),
o AS (SELECT sensor, part, base, coalesce(sum(greatest(0, top - base) + 1) OVER (PARTITION BY sensor ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT sensor, part, line_no, CAST(frame - base + off AS BIGINT) AS frame FROM motion JOIN o USING (sensor, part)""",
)
def rebased_frames(t):
    return intervals.rebase_frames(motion(t).select("sensor", "part", "line_no", "frame"), "sensor")


@query("sensors_first_seen", f"WITH {MOTION_SQL} SELECT sensor, min(line_no) AS first_line FROM motion GROUP BY 1")
def sensors_first_seen(t):
    return intervals.first_seen(motion(t))


@query(
    "dense_segments",
    f"""WITH {RUN_SQL}, hits AS (
  SELECT m.room, run_id, CASE WHEN k % 50 <> 0 THEN frame END AS ts FROM motion m JOIN merged s ON s.room = m.room AND m.frame >= s.start AND m.frame <= s."end")
SELECT room, run_id, count(*) AS n_events FROM hits GROUP BY 1, 2 HAVING count(*) > 2 AND count(ts) = count(*)""",
)
def dense_segments(t):
    points = motion(t).select("room", "frame", F.when(F.col("k") % 50 != 0, F.col("frame")).alias("ts"))
    return intervals.dense_segments(intervals.interval_join(points, merged_runs(t), ["room"], "frame", width=200), ["room", "run_id"])


@query(
    "packed_segments",
    f"""WITH {INTERVAL_SQL}, tr AS (SELECT sensor, start AS frame, 'ON' AS state FROM spans UNION ALL SELECT sensor, last + 1, 'OFF' FROM spans)
SELECT sensor, frame // 2880 AS part, list(frame ORDER BY frame, state) AS times, list(state ORDER BY frame, state) AS states,
  list(sensor ORDER BY frame, state) AS sensors FROM tr GROUP BY 1, 2""",
)
def packed_segments(t):
    tr = intervals.transitions(intervals.active_intervals(motion(t), ["sensor"]), ["sensor"])
    tr = tr.withColumn("part", F.floor(F.col("frame") / 2880)).withColumn("_s", F.col("sensor"))
    rows = tr.select("part", F.col("_s").alias("of_sensor"), "frame", "sensor", "state")
    return intervals.pack_segments(rows, ["of_sensor", "part"]).withColumnRenamed("of_sensor", "sensor")


LABEL_PICK = {
    s: f"CASE k % {len(n) + 1} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(n)) + " ELSE 'unheard' END"
    for s, n in SCHEMES.items()
}


def _ids(s):
    n = len(SCHEMES[s]) + 1
    return f"CASE WHEN k % {n} = {n - 1} THEN -1 ELSE CAST(k % {n} AS INT) END"


@query(
    "label_class_ids",
    f"WITH {MOTION_SQL} " + " UNION ALL ".join(f"SELECT line_no, '{s}' AS scheme, {_ids(s)} AS class_id FROM motion" for s in SCHEMES),
)
def label_class_ids(t):
    rows = motion(t).select("line_no", *[F.upper(F.expr(e)).alias(s) for s, e in LABEL_PICK.items()])
    return intervals.unpivot_labels(intervals.label_columns(rows), ["line_no"])


@query("clock_times")
def clock_times(t):
    minute = F.when(F.col("k") % 50 != 0, F.floor(F.col("frame") / 2) % 1440).cast("bigint")
    rows = motion(t).select("room", "line_no", minute.alias("minute"))
    return intervals.clock_times(rows, ["room"], "line_no", "minute", seed=7)


FILE_NAME = "'part_' || CAST({p} AS STRING) || '_label_regenerated_u' || CAST(sensor AS STRING) || '_routine_env_1_Monday_parsed_grounded_' || room || '.txt'"


@query(
    "paired_part_files",
    f"""WITH {MOTION_SQL}, m AS (SELECT DISTINCT part, sensor, room FROM motion WHERE k % 2 = 0), r AS (SELECT DISTINCT part, sensor, room FROM motion WHERE k % 2 = 1)
SELECT 'u' || CAST(m.sensor AS VARCHAR) || '_routine_env_1_Monday' AS person_day, m.part,
  'motion_part_' || CAST(m.part AS VARCHAR) || '_label_regenerated_u' || CAST(m.sensor AS VARCHAR) || '_routine_env_1_Monday_parsed_grounded_' || m.room || '.txt.txt' AS motion_file,
  'range_part_' || CAST(r.part AS VARCHAR) || '_label_regenerated_u' || CAST(r.sensor AS VARCHAR) || '_routine_env_1_Monday_parsed_grounded_' || r.room || '.txt' AS range_file
FROM m JOIN r ON m.sensor = r.sensor AND m.part = r.part""",
)
def paired_part_files(t):
    name = F.expr(FILE_NAME.format(p="part"))
    files = motion(t).select(
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("motion_"), name, F.lit(".txt"))).otherwise(F.concat(F.lit("range_"), name)).alias("file_name")
    ).distinct()
    return intervals.pair_part_files(files)


@query(
    "choice_or_fallback",
    """SELECT p_partkey, CASE lower(replace(split_part(p_name, ' ', 2), ' ', '')) WHEN 'ring' THEN 'other' ELSE 'other' END AS aruba,
  CASE WHEN p_size % 5 = 0 THEN 'enter_Home' WHEN p_size % 5 = 1 THEN 'work' ELSE 'other' END AS label FROM part""",
)
def choice_or_fallback(t):
    said = F.expr("CASE p_size % 5 WHEN 0 THEN ' Enter_HOME ' WHEN 1 THEN 'wo rk' ELSE p_name END")
    rows = t.part.select("p_partkey", F.expr("split(p_name, ' ')[1]").alias("word"), said.alias("said"))
    return rows.select("p_partkey", choose("word", "aruba").alias("aruba"), choose("said", "aruba").alias("label"))
