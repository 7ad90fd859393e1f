"""Household routine text: parsing, grounding repair, labels, parts and schedules.

Lines are rows ``(file, line_no, text)``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.labels import ROOMS
from tidewright.functions.text import trim_space
from tidewright.operators.evaluation import arity
from tidewright.operators.scan import chunk_of, scan

# The line formats of routines, steps and schedules, and the day names.
HEADER = "^(\\d{1,2}:\\d{1,2}) - \\d{1,2}:\\d{1,2}, (.+?): (.+)"
STEP = "^Step\\s+(\\d+):\\s*(.+)"
ACTION = "^\\[(.*?)\\]"
OBJECTS = "<(.*?)>"
LAST_ROOM = "\\(([^()]*)\\)\\s*$"
TIME_RANGE = "\\((\\d{1,2}:\\d{2}) - (\\d{1,2}:\\d{2})\\)"
SCRIPT_ARGS = "<(.*?)> \\((\\d+)\\)"
SLOT = "([a-zA-Z_]+) \\((\\d{2}:\\d{2}) - (\\d{2}:\\d{2}(?: \\d+day)?(?: \\d{2}:\\d{2})?)\\) \\((at home|outside)\\)"
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

CHUNK_LINES = 10_000


def normalise(name) -> Column:
    """Lower case without underscores and blanks."""
    return F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), "[_ ]", "")


def with_days(lines: DataFrame, chunk_lines=CHUNK_LINES) -> DataFrame:
    """Add the day whose head line is the last at or before each line; lines before the first head get NULL."""
    head = F.regexp_extract(F.trim("text"), "^(" + "|".join(DAYS) + "):", 1)
    marked = lines.withColumn("_day", F.when(head != "", head))
    return scan(marked, ["file"], "line_no", chunk_of("line_no", chunk_lines), last={"day": "_day"}).drop("_day")


def parse_routine(lines: DataFrame, chunk_lines=CHUNK_LINES) -> DataFrame:
    """Step rows ``(file, block_no, line_no, text, activity)``: each header opens a block with a walk to its room.

    Steps carry the room of the last header; other lines drop out.
    """
    t = trim_space("text")
    is_head, is_step = t.rlike(HEADER), t.rlike(STEP)
    tidy = lines.where(is_head | is_step).withColumns(
        {
            "_head": is_head.cast("bigint"),
            "_room": F.when(is_head, F.regexp_replace(F.lower(trim_space(F.regexp_extract(t, HEADER, 2))), " ", "")),
            "_start": F.regexp_extract(t, HEADER, 1),
            "_step": F.regexp_extract(t, STEP, 2),
            "_activity": F.when(is_head, F.regexp_extract(t, HEADER, 3)),
        }
    ).drop("text")
    seen = scan(tidy, ["file"], "line_no", chunk_of("line_no", chunk_lines), last={"room": "_room", "activity": "_activity"}, cumsum={"block_no": "_head"})
    walk = F.concat(F.lit("[walk] <"), "room", F.lit("> ("), "_start", F.lit(" - "), "_start", F.lit(") ("), "room", F.lit(")"))
    step = F.concat("_step", F.lit(" ("), F.coalesce("room", F.lit("None")), F.lit(")"))
    text = F.when(F.col("_head") == 1, walk).otherwise(step)
    return seen.select("file", "block_no", "line_no", text.alias("text"), "room", "activity")


def blocks_by_blank(lines: DataFrame, chunk_lines=CHUNK_LINES) -> DataFrame:
    """Number blocks of lines set apart by blank lines; blank lines drop out."""
    blank = trim_space("text") == ""
    marked = lines.withColumn("_blank", blank.cast("bigint"))
    opened = scan(marked, ["file"], "line_no", chunk_of("line_no", chunk_lines), lag={"_was": "_blank"})
    starts = (F.col("_blank") == 0) & (F.coalesce("_was", F.lit(1)) == 1)
    numbered = scan(opened.withColumn("_open", starts.cast("bigint")), ["file"], "line_no", chunk_of("line_no", chunk_lines), cumsum={"block_no": "_open"})
    return numbered.where("_blank = 0").drop("_blank", "_was", "_open")


def parse_steps(lines: DataFrame) -> DataFrame:
    """Action, objects, time range and room of step lines; a line without a room gets ``unknown``."""
    t = F.col("text")
    action = F.regexp_extract(t, ACTION, 1)
    room = F.lower(F.regexp_extract(t, LAST_ROOM, 1))
    return lines.withColumns(
        {
            "action": F.when(t.rlike(ACTION), action),
            "objects": F.regexp_extract_all(t, F.lit(OBJECTS), F.lit(1)),
            "t0": F.nullif(F.regexp_extract(t, TIME_RANGE, 1), F.lit("")),
            "t1": F.nullif(F.regexp_extract(t, TIME_RANGE, 2), F.lit("")),
            "room": F.when(t.rlike(LAST_ROOM), room).otherwise("unknown"),
        }
    )


def parse_script(lines: DataFrame) -> DataFrame:
    """Action, object names and instance numbers of ``[A] <o> (1) <s> (2)`` lines, with an arity verdict."""
    t = F.col("text")
    names = F.regexp_extract_all(t, F.lit(SCRIPT_ARGS), F.lit(1))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(SCRIPT_ARGS), F.lit(2)), lambda n: n.cast("int"))
    rows = lines.withColumns({"action": F.lower(F.regexp_extract(t, ACTION, 1)), "objects": names, "instances": numbers})
    return rows.withColumn("is_valid", F.coalesce(F.size("objects") == arity("action"), F.lit(False)))


def needs_repair() -> Column:
    """A grounded step with no action, an empty object, or the wrong number of objects for a known action."""
    wrong = F.coalesce(F.size("objects") != arity("action"), F.lit(False))
    return (F.col("text") == "[]") | F.contains("text", F.lit("<>")) | wrong


def repair_steps(grounded: DataFrame, parsed: DataFrame, fixes: DataFrame):
    """``(repaired, report)``: grounded lines with fixes put in, and the lines that needed one with their source."""
    keys = ["file", "block_no", "line_no"]
    broken = grounded.withColumn("_broken", needs_repair())
    joined = broken.join(fixes.select(*keys, F.col("text").alias("_fix")), keys, "left")
    text = F.when(F.col("_broken"), F.coalesce("_fix", "text")).otherwise(F.col("text"))
    report = joined.where("_broken").join(parsed.select(*keys, F.col("text").alias("parsed")), keys, "left")
    report = report.select(*keys, "parsed", F.col("text").alias("grounded"), "_fix").withColumnRenamed("_fix", "fixed")
    return joined.select(*keys, text.alias("text")), report


def label_blocks(steps: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """Stamp block labels on every step of files whose activity names and blocks agree in number.

    ``steps(file, block_no, ...)``, ``names(file, line_no, activity)``, ``labels(activity, ...)``; the n-th name belongs to
    the n-th block.
    """
    order = names.withColumn("_one", F.lit(1))
    ranked = scan(order, ["file"], "line_no", chunk_of("line_no", CHUNK_LINES), cumsum={"block_no": "_one"}).drop("_one", "line_no")
    n_names = ranked.groupBy("file").agg(F.count("*").alias("_names"))
    n_blocks = steps.groupBy("file").agg(F.count_distinct("block_no").alias("_blocks"))
    agreed = n_names.join(n_blocks, "file").where("_names = _blocks").select("file")
    named = ranked.join(agreed, "file", "left_semi").join(labels, "activity", "left")
    return steps.join(named, ["file", "block_no"])


def block_parts(blocks: DataFrame, size=4) -> DataFrame:
    """``(file, part, room)``: parts of ``size`` blocks; a part starts in the last room named by the block before it.

    ``blocks(file, block_no, text)``. The first part starts in the bedroom.
    """
    named = F.filter(F.regexp_extract_all("text", F.lit("\\(([^()]+)\\)"), F.lit(1)), lambda r: F.lower(r).isin(ROOMS))
    last = F.coalesce(F.lower(F.get(F.reverse(named), F.lit(0))), F.lit("unknown"))
    part = F.floor((F.col("block_no") - 1) / size).cast("bigint") + 1
    # the room a part starts in is read off the last block of the part before it, so no sequence scan is needed
    parts = blocks.groupBy("file", part.alias("part")).agg(F.count("*").alias("n_blocks"))
    ends = blocks.where(F.col("block_no") % size == 0).select("file", (part + 1).alias("part"), last.alias("_room"))
    joined = parts.join(ends, ["file", "part"], "left")
    room = F.when(F.col("part") == 1, "bedroom").otherwise(F.coalesce("_room", F.lit("unknown")))
    return joined.select("file", "part", "n_blocks", room.alias("room"))


def home_slots(schedules: DataFrame) -> DataFrame:
    """``(file, day, activity, t0, t1)`` of schedule slots at home.

    ``schedules(file, day, text)`` hold the text of one day.
    """
    slots = F.regexp_extract_all("text", F.lit(SLOT), F.lit(0))
    rows = schedules.select("file", "day", F.posexplode(slots).alias("slot_no", "_s"))
    return rows.where(F.regexp_extract("_s", SLOT, 4) == "at home").select(
        "file", "day", "slot_no", *[F.regexp_extract("_s", SLOT, i).alias(n) for i, n in ((1, "activity"), (2, "t0"), (3, "t1"))]
    )


def day_times(slots: DataFrame) -> DataFrame:
    """First start and last end of the clock ranges of each day."""
    return slots.groupBy("file", "day_no").agg(F.min_by("t0", "slot_no").alias("wake"), F.max_by("t1", "slot_no").alias("sleep"))


def link_nights(slots: DataFrame) -> DataFrame:
    """Replace the last slot of a day by sleep until the next day's first slot.

    ``slots(file, day_no, slot_no, activity, t0, t1, place)``. Days are few per file, so one window orders them.
    """
    times = day_times(slots)
    w = Window.partitionBy("file").orderBy("day_no")
    ends = times.withColumn("_next", F.lead("wake").over(w))
    last = slots.groupBy("file", "day_no").agg(F.max("slot_no").alias("_last"))
    joined = slots.join(ends, ["file", "day_no"]).join(last, ["file", "day_no"])
    swap = (F.col("slot_no") == F.col("_last")) & F.col("_next").isNotNull()
    return joined.select(
        "file", "day_no", "slot_no",
        F.when(swap, "sleep").otherwise(F.col("activity")).alias("activity"),
        F.when(swap, F.col("sleep")).otherwise(F.col("t0")).alias("t0"),
        F.when(swap, F.col("_next")).otherwise(F.col("t1")).alias("t1"),
        F.when(swap, "at home").otherwise(F.col("place")).alias("place"),
    )
