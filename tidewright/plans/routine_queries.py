"""Routine-text queries; the routine lines are worded from the event log, one file per user."""

from pyspark.sql import functions as F

from tidewright.operators import evaluation, routine
from tidewright.plans.registry import query

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
ROOM = "CASE k % 4 WHEN 0 THEN 'Bedroom' WHEN 1 THEN 'Kitchen' WHEN 2 THEN 'Bathroom' ELSE 'Living Room' END"
CLOCK = "lpad(CAST(k % 24 AS STRING), 2, '0') || ':' || lpad(CAST(k % 60 AS STRING), 2, '0')"
ACTION = "CASE k % 7 WHEN 0 THEN 'walk' WHEN 1 THEN 'grab' WHEN 2 THEN 'put' WHEN 3 THEN 'dance' WHEN 4 THEN 'standup' ELSE 'open' END"
OBJECTS = "CASE WHEN k % 7 = 4 THEN '' WHEN k % 11 = 0 THEN ' <>' WHEN k % 7 = 2 AND k % 3 <> 0 THEN ' <' || event_type || '> <kitchen>' ELSE ' <' || event_type || '>' END"
GROUNDED = f"CASE WHEN k % 13 = 0 THEN '[]' ELSE '[' || {ACTION} || ']' || {OBJECTS} || ' (' || {CLOCK} || ' - ' || {CLOCK} || ') (' || lower(replace({ROOM}, ' ', '')) || ')' END"
LINE = f"CASE WHEN k % 5 = 0 THEN {CLOCK} || ' - ' || {CLOCK} || ', ' || {ROOM} || ': ' || event_type WHEN k % 17 = 0 THEN 'note' ELSE 'Step ' || CAST(k AS STRING) || ': [' || {ACTION} || ']' || {OBJECTS} || ' (' || {CLOCK} || ' - ' || {CLOCK} || ')' END"
RAW_SQL = f"raw AS (SELECT user_id AS file, event_id AS line_no, event_type, {K} AS k FROM events)"


def raw(t):
    return t.events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), "event_type", F.expr(K).alias("k"))


@query(
    "parsed_routines",
    f"""WITH {RAW_SQL}, l AS (SELECT *, k % 5 = 0 AS head, lower(replace({ROOM}, ' ', '')) AS r, {CLOCK} AS c FROM raw WHERE k % 5 = 0 OR k % 17 <> 0),
s AS (SELECT file, line_no, k, event_type, head, c, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS block_no, last_value(CASE WHEN head THEN r END IGNORE NULLS) OVER w AS room,
  last_value(CASE WHEN head THEN event_type END IGNORE NULLS) OVER w AS activity FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT file, CAST(block_no AS BIGINT) AS block_no, line_no, room, activity, CASE WHEN head THEN '[walk] <' || room || '> (' || c || ' - ' || c || ') (' || room || ')'
  ELSE '[' || {ACTION} || ']' || {OBJECTS} || ' (' || c || ' - ' || c || ') (' || coalesce(room, 'None') || ')' END AS text FROM s""",
)
def parsed_routines(t):
    lines = raw(t).select("file", "line_no", F.expr(LINE).alias("text"))
    return routine.parse_routine(lines, 500)


@query(
    "lines_by_day",
    f"""WITH {RAW_SQL} SELECT file, line_no, last_value(CASE k % 50 WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Sunday' END IGNORE NULLS)
  OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS day FROM raw""",
)
def lines_by_day(t):
    text = "CASE k % 50 WHEN 0 THEN 'Monday: x' WHEN 1 THEN ' Tuesday:' WHEN 2 THEN 'Sunday:' ELSE 'on Monday: ' END"
    lines = raw(t).select("file", "line_no", F.expr(text).alias("text"))
    return routine.with_days(lines, 500).select("file", "line_no", "day")


@query(
    "blocks_by_blank",
    f"""WITH {RAW_SQL}, b AS (SELECT *, k % 6 = 0 AS blank, coalesce(lag(k % 6 = 0) OVER (PARTITION BY file ORDER BY line_no), true) AS was FROM raw)
SELECT file, line_no, CAST(block_no AS BIGINT) AS block_no FROM (SELECT *, sum(CASE WHEN NOT blank AND was THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS block_no FROM b) WHERE NOT blank""",
)
def blocks_by_blank(t):
    lines = raw(t).select("file", "line_no", F.when(F.col("k") % 6 == 0, "  ").otherwise(F.col("event_type")).alias("text"))
    return routine.blocks_by_blank(lines, 500).select("file", "line_no", "block_no")


EXPECTED = "CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN 0 ELSE 1 END"
N_OBJ = "CASE WHEN k % 7 = 4 THEN 0 WHEN k % 11 = 0 THEN 1 WHEN k % 7 = 2 AND k % 3 <> 0 THEN 2 ELSE 1 END"
STEP_SQL = f"""{RAW_SQL}, st AS (SELECT file, line_no, event_type, k, k % 13 = 0 AS missing, {EXPECTED} AS expected, {N_OBJ} AS n_obj,
  k % 7 <> 4 AND k % 11 = 0 AS hole, lower(replace({ROOM}, ' ', '')) AS room, {GROUNDED} AS text FROM raw)"""


def grounded(t):
    return routine.parse_steps(raw(t).select("file", "line_no", F.expr(GROUNDED).alias("text")))


@query(
    "parsed_steps",
    f"""WITH {STEP_SQL} SELECT file, line_no, CASE WHEN NOT missing THEN {ACTION} END AS action, CAST(CASE WHEN missing THEN 0 ELSE n_obj END AS INT) AS n_objects,
  CASE WHEN NOT missing THEN {CLOCK} END AS t0, CASE WHEN missing THEN 'unknown' ELSE room END AS room FROM st""",
)
def parsed_steps(t):
    rows = grounded(t)
    return rows.select("file", "line_no", F.nullif("action", F.lit("")).alias("action"), F.size("objects").alias("n_objects"), "t0", "room")


@query(
    "format_report",
    f"""WITH {STEP_SQL}, allowed AS (SELECT DISTINCT room, event_type FROM st WHERE k % 3 = 0 AND NOT missing),
o AS (SELECT st.*, NOT missing AND NOT hole AND n_obj > 0 AS has_obj, CASE WHEN NOT missing AND NOT hole AND n_obj > 0 AND a.room IS NULL THEN 1 ELSE 0 END AS misplaced
  FROM st LEFT JOIN allowed a ON a.room = st.room AND a.event_type = st.event_type),
f AS (SELECT *, NOT missing AND expected IS NULL AS unk, NOT missing AND expected IS NOT NULL AND n_obj <> expected AS bad FROM o),
g AS (SELECT file, count(*) AS total_lines, count(*) FILTER (WHERE missing OR unk OR hole OR bad OR misplaced > 0) AS wrong_lines, count(*) FILTER (WHERE bad) AS invalid_format,
  count(*) FILTER (WHERE missing) AS missing_actions, count(*) FILTER (WHERE unk) AS unknown_actions, count(*) FILTER (WHERE hole AND NOT missing) AS missing_objects,
  CAST(sum(CASE WHEN has_obj THEN n_obj ELSE 0 END) AS BIGINT) AS objects_checked, CAST(sum(misplaced) AS BIGINT) AS misplaced_objects FROM f GROUP BY 1)
SELECT *, round(wrong_lines / total_lines * 100, 6) AS wrong_line_pct, CASE WHEN objects_checked > 0 THEN round(misplaced_objects / objects_checked * 100, 6) ELSE 0.0 END AS misplaced_object_pct FROM g""",
)
def format_report(t):
    rows = grounded(t)
    keyed = raw(t).where("k % 3 = 0 AND k % 13 <> 0").select(F.expr(f"lower(replace({ROOM}, ' ', ''))").alias("room"), F.col("event_type").alias("object")).distinct()
    return evaluation.format_report(rows, keyed)


@query(
    "repaired_steps",
    f"""WITH {STEP_SQL}, b AS (SELECT *, missing OR hole OR (expected IS NOT NULL AND n_obj <> expected AND NOT missing) AS broken FROM st)
SELECT file, line_no, CASE WHEN broken AND k % 2 = 0 THEN '[open] <door> (' || room || ')' ELSE text END AS text FROM b""",
)
def repaired_steps(t):
    rows = grounded(t).withColumn("block_no", F.lit(1))
    fixes = raw(t).where("k % 2 = 0").select("file", F.lit(1).alias("block_no"), "line_no", F.expr(f"'[open] <door> (' || lower(replace({ROOM}, ' ', '')) || ')'").alias("text"))
    repaired, _ = routine.repair_steps(rows, rows, fixes)
    return repaired.select("file", "line_no", "text")


@query(
    "labelled_steps",
    """WITH n AS (SELECT conv_id AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS block_no, role AS activity FROM conversations),
s AS (SELECT conv_id AS file, CASE WHEN conv_id % 3 = 0 THEN turn // 2 + 1 ELSE turn + 1 END AS block_no, turn AS line_no FROM conversations),
c AS (SELECT file FROM (SELECT file, count(*) AS a FROM n GROUP BY 1) JOIN (SELECT file, count(DISTINCT block_no) AS b FROM s GROUP BY 1) USING (file) WHERE a = b)
SELECT s.file, s.block_no, s.line_no, n.activity, CASE WHEN activity <> 'system' THEN 'lab_' || activity END AS aruba FROM s JOIN n USING (file, block_no) WHERE file IN (SELECT file FROM c)""",
)
def labelled_steps(t):
    base = t.conversations.select(F.col("conv_id").alias("file"), "turn", "role")
    names = base.select("file", F.col("turn").alias("line_no"), F.col("role").alias("activity"))
    block = F.when(F.col("file") % 3 == 0, F.floor(F.col("turn") / 2) + 1).otherwise(F.col("turn") + 1)
    steps = base.select("file", block.alias("block_no"), F.col("turn").alias("line_no"))
    labels = base.where("role <> 'system'").select(F.col("role").alias("activity"), F.concat(F.lit("lab_"), "role").alias("aruba")).distinct()
    return routine.label_blocks(steps, names, labels).select("file", "block_no", "line_no", "activity", "aruba")


@query(
    "block_parts",
    f"""WITH {RAW_SQL}, b AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) AS block_no, k FROM raw),
p AS (SELECT file, (block_no - 1) // 4 + 1 AS part, count(*) AS n_blocks, max(CASE WHEN block_no % 4 = 0 THEN k END) AS k4 FROM b GROUP BY 1, 2)
SELECT file, part, n_blocks, coalesce(lag(CASE k4 % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'bathroom' ELSE 'unknown' END) OVER (PARTITION BY file ORDER BY part), 'bedroom') AS room FROM p""",
)
def block_parts(t):
    numbered = routine.scan(raw(t).withColumn("one", F.lit(1)), ["file"], "line_no", routine.chunk_of("line_no", 500), cumsum={"block_no": "one"})
    text = "CASE k % 3 WHEN 0 THEN '[a] (Bedroom) (x)\n[b] (Kitchen) (7:00 - 7:01)' WHEN 1 THEN '[a] (bathroom)' ELSE 'no room (here)' END"
    return routine.block_parts(numbered.select("file", "block_no", F.expr(text).alias("text")))


SLOTS_SQL = f"""{RAW_SQL}, sl AS (SELECT file, k % 7 AS day_no, line_no AS slot_no, event_type AS activity, {CLOCK} AS t0, lpad(CAST((k + 1) % 24 AS VARCHAR), 2, '0') || ':30' AS t1,
  CASE WHEN k % 3 = 0 THEN 'outside' ELSE 'at home' END AS place FROM raw)"""


def slots(t):
    rows = raw(t).withColumns({"t0": F.expr(CLOCK), "t1": F.expr("lpad(CAST((k + 1) % 24 AS STRING), 2, '0') || ':30'"), "place": F.expr("CASE WHEN k % 3 = 0 THEN 'outside' ELSE 'at home' END")})
    return rows.select("file", (F.col("k") % 7).alias("day_no"), F.col("line_no").alias("slot_no"), F.col("event_type").alias("activity"), "t0", "t1", "place")


@query(
    "linked_nights",
    f"""WITH {SLOTS_SQL}, d AS (SELECT file, day_no, min_by(t0, slot_no) AS wake, max_by(t1, slot_no) AS sleep, max(slot_no) AS last FROM sl GROUP BY 1, 2),
n AS (SELECT *, lead(wake) OVER (PARTITION BY file ORDER BY day_no) AS nxt FROM d)
SELECT file, day_no, slot_no, CASE WHEN slot_no = last AND nxt IS NOT NULL THEN 'sleep' ELSE activity END AS activity, CASE WHEN slot_no = last AND nxt IS NOT NULL THEN sleep ELSE t0 END AS t0,
  CASE WHEN slot_no = last AND nxt IS NOT NULL THEN nxt ELSE t1 END AS t1, CASE WHEN slot_no = last AND nxt IS NOT NULL THEN 'at home' ELSE place END AS place FROM sl JOIN n USING (file, day_no)""",
)
def linked_nights(t):
    return routine.link_nights(slots(t))


@query("day_times", f"WITH {SLOTS_SQL} SELECT file, day_no, min_by(t0, slot_no) AS wake, max_by(t1, slot_no) AS sleep FROM sl GROUP BY 1, 2")
def day_times(t):
    return routine.day_times(slots(t))


@query(
    "home_slots",
    f"WITH {SLOTS_SQL} SELECT file, day_no AS day, activity, t0, t1 FROM sl WHERE place = 'at home'",
)
def home_slots(t):
    line = F.format_string("%s (%s - %s) (%s)", "activity", "t0", "t1", "place")
    days = slots(t).withColumn("line", line).groupBy("file", F.col("day_no").alias("day")).agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    return routine.home_slots(days).select("file", "day", "activity", "t0", "t1")


@query(
    "script_lines",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'put' AS action, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n_objects, CAST(l_suppkey AS INT) AS first_instance, l_linenumber % 2 = 0 AS is_valid FROM lineitem""",
)
def script_lines(t):
    text = F.concat(F.lit("[Put] <cup> ("), F.col("l_suppkey").cast("string"), F.lit(")"), F.when(F.col("l_linenumber") % 2 == 0, " <table> (7)").otherwise(""))
    rows = routine.parse_script(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "action", F.size("objects").alias("n_objects"), F.col("instances")[0].alias("first_instance"), "is_valid")


@query("normalised_names", "SELECT p_partkey, replace(replace(lower(p_name || '_' || p_brand), '_', ''), ' ', '') AS name FROM part")
def normalised_names(t):
    return t.part.select("p_partkey", routine.normalise(F.concat_ws("_", "p_name", "p_brand")).alias("name"))


@query(
    "objects_in_rooms",
    f"""WITH {RAW_SQL}, o AS (SELECT file, line_no, lower(replace({ROOM}, ' ', '')) AS room, event_type AS object, k FROM raw), a AS (SELECT DISTINCT room, object FROM o WHERE k % 2 = 0)
SELECT file, line_no, o.room, o.object, a.room IS NOT NULL AS fits FROM o LEFT JOIN a ON a.room = o.room AND a.object = o.object""",
)
def objects_in_rooms(t):
    rows = raw(t).select("file", "line_no", F.expr(f"lower(replace({ROOM}, ' ', ''))").alias("room"), F.col("event_type").alias("object"), "k")
    allowed = rows.where("k % 2 = 0").select("room", "object").distinct().withColumn("_fits", F.lit(True))
    return rows.join(allowed, ["room", "object"], "left").select("file", "line_no", "room", "object", F.coalesce("_fits", F.lit(False)).alias("fits"))
