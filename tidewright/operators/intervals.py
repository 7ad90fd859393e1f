"""Sensor intervals, frame bookkeeping, interval joins and labelled segments."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.draws import uniform
from tidewright.functions.labels import SCHEMES, class_id
from tidewright.operators.scan import chunk_of, islands, scan


def magnitude(x="x", y="y", z="z") -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def frame_of(file_name) -> Column:
    """Frame number at the end of a file name, before its extension; NULL when there is none."""
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    return F.regexp_extract(name, r"(\d+)(?:\.[A-Za-z0-9]+)?$", 1).try_cast("bigint")


def active_intervals(motion: DataFrame, keys, frame="frame", gap=20, chunk_frames=100_000) -> DataFrame:
    """Intervals ``[start, last]`` in which a sensor fired with pauses shorter than ``gap`` frames."""
    keys = list(keys)
    on = motion.where(magnitude() > 0).select(*keys, frame).distinct()
    runs = islands(on, keys, frame, chunk_of(frame, chunk_frames), frame, lambda p, c: c - p >= gap)
    return runs.groupBy(*keys, "run_id").agg(F.min(frame).alias("start"), F.max(frame).alias("last"))


def transitions(intervals: DataFrame, keys) -> DataFrame:
    """ON at the start of each interval, OFF one frame after its last."""
    on = F.struct(F.col("start").alias("frame"), F.lit("ON").alias("state"))
    off = F.struct((F.col("last") + 1).alias("frame"), F.lit("OFF").alias("state"))
    return intervals.select(*keys, F.explode(F.array(on, off)).alias("e")).select(*keys, "e.frame", "e.state")


def collapse_runs(rows: DataFrame, keys, order, label: str, chunk: Column) -> DataFrame:
    """Merge neighbouring rows with the same label; the frame range runs to the end of the last row."""
    keys = list(keys)
    runs = islands(rows, keys, order, chunk, label, lambda p, c: ~p.eqNullSafe(c))
    at = F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order)])
    return runs.groupBy(*keys, "run_id").agg(
        F.min_by(label, at).alias(label), F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end")
    )


def interval_join(points: DataFrame, spans: DataFrame, keys, at: str, start="start", end="end", width=1000) -> DataFrame:
    """Points with the spans that contain them (both ends inclusive).

    Spans are repeated once per bucket of ``width`` they touch, so the join is an equi-join on
    (key, bucket). ``width`` near the usual span length keeps that repetition close to one.
    """
    cut = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    covered = spans.withColumn("_bucket", F.explode(F.sequence(cut(start), cut(end))))
    placed = points.withColumn("_bucket", cut(at))
    joined = placed.join(covered, [*keys, "_bucket"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def first_match(points: DataFrame, spans: DataFrame, keys, at: str, line="line_no", pick="hhmm", width=1000) -> DataFrame:
    """Each distinct (key, ``at``) with ``pick`` of the earliest containing span, NULL when there is none."""
    keys = list(keys)
    asked = points.select(*keys, at).distinct()
    hits = interval_join(asked, spans, keys, at, width=width)
    best = hits.groupBy(*keys, at).agg(F.min_by(pick, line).alias(pick))
    return asked.join(best, [*keys, at], "left")


def continue_ranges(lines: DataFrame, key: str, chunk_parts=64) -> DataFrame:
    """Shift the frame ranges of later parts so that they go on where the one before ended.

    Ranges of the first part stay; every later range starts one frame after the previous end.
    """
    parts = lines.select(key, "part").distinct()
    heads = parts.groupBy(key).agg(F.min("part").alias("_first"))
    marked = lines.join(heads, key).withColumn("_later", F.col("part") > F.col("_first"))
    base = (
        marked.where(~F.col("_later")).groupBy(key).agg(F.max_by("end", "line_no").alias("_base"))
    )
    grown = marked.withColumn("_grow", F.when(F.col("_later"), F.col("end") - F.col("start") + 1).otherwise(0))
    run = scan(grown, [key], ["part", "line_no"], F.floor(F.col("part") / chunk_parts), cumsum={"_run": "_grow"})
    out = run.join(base, key)
    new_end = F.when(F.col("_later"), F.col("_base") + F.col("_run")).otherwise(F.col("end"))
    return out.select(
        key, "part", "line_no", (new_end - (F.col("end") - F.col("start"))).alias("start"), new_end.alias("end")
    )


def rebase_frames(motion: DataFrame, key: str) -> DataFrame:
    """Frames counted from each part's first line, then set one after another without gaps."""
    spans = motion.groupBy(key, "part").agg(F.min_by("frame", "line_no").alias("_base"), F.max("frame").alias("_top"))
    length = F.greatest(F.lit(0), F.col("_top") - F.col("_base")) + 1
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("_offset", F.coalesce(F.sum(length).over(w), F.lit(0))).drop("_top")
    return motion.join(offsets, [key, "part"]).withColumn(
        "frame", F.col("frame") - F.col("_base") + F.col("_offset")
    ).drop("_base", "_offset")


def first_seen(motion: DataFrame, sensor="sensor", line="line_no") -> DataFrame:
    """Sensors with the line of their first appearance."""
    return motion.groupBy(sensor).agg(F.min(line).alias("first_line"))


def clock_times(rows: DataFrame, keys, order: str, minute: str, seed=0, chunk_rows=100_000) -> DataFrame:
    """A second-exact clock time for rows that only know their minute of the day.

    The first row of a minute gets a drawn second, each later one ten seconds more, carrying into
    the next minute. Rows without a minute stay NULL.
    """
    keys = list(keys)
    known = rows.where(F.col(minute).isNotNull())
    runs = islands(known, keys, order, chunk_of(order, chunk_rows), minute, lambda p, c: p != c)
    runs = runs.withColumn("_one", F.lit(1))
    ranked = scan(runs, [*keys, "run_id"], order, chunk_of(order, chunk_rows), cumsum={"_rank": "_one"})
    second = F.floor(uniform(seed, F.col("run_id"), F.col(minute)) * 60)
    total = F.col(minute) * 60 + second + (F.col("_rank") - 1) * 10
    timed = ranked.withColumn("second_of_day", total.cast("bigint")).drop("_one", "_rank", "run_id")
    return timed.unionByName(rows.where(F.col(minute).isNull()).withColumn("second_of_day", F.lit(None).cast("bigint")))


def dense_segments(events: DataFrame, segment_keys, time="ts", more_than=2) -> DataFrame:
    """Segments with more than ``more_than`` events, none of which lacks a time."""
    counts = events.groupBy(*segment_keys).agg(F.count("*").alias("n_events"), F.count(time).alias("_timed"))
    return counts.where((F.col("n_events") > more_than) & (F.col("_timed") == F.col("n_events"))).drop("_timed")


def pack_segments(events: DataFrame, segment_keys, order="frame") -> DataFrame:
    """One row per segment with parallel time, sensor and state arrays in time order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "sensor", "state")))
    packed = events.groupBy(*segment_keys).agg(rows.alias("_r"))
    return packed.select(
        *segment_keys,
        F.col(f"_r.{order}").alias("times"),
        F.col("_r.sensor").alias("sensors"),
        F.col("_r.state").alias("states"),
    )


def label_columns(rows: DataFrame) -> DataFrame:
    """Class numbers of the five label columns."""
    return rows.withColumns({f"{s}_id": class_id(s, s) for s in SCHEMES})


def unpivot_labels(rows: DataFrame, ids) -> DataFrame:
    """One (scheme, class number) row per label column, the shape of the exported label vectors."""
    return rows.unpivot(list(ids), [f"{s}_id" for s in SCHEMES], "scheme", "class_id").withColumn(
        "scheme", F.regexp_replace("scheme", "_id$", "")
    )


PART_FILE = r"(motion|range)_part_(\d+)_label_regenerated_(.*?_routine_env_\d+_\w+)_parsed_grounded_.*?\.txt"


def part_file_keys(files: DataFrame, name="file_name") -> DataFrame:
    """Kind, part number and person-day of part files; other files drop out."""
    got = files.where(F.col(name).rlike("^" + PART_FILE))
    return got.withColumns(
        {
            "kind": F.regexp_extract(name, PART_FILE, 1),
            "part": F.regexp_extract(name, PART_FILE, 2).cast("bigint"),
            "person_day": F.regexp_extract(name, PART_FILE, 3),
        }
    )


def pair_part_files(files: DataFrame) -> DataFrame:
    """Motion files with the range file of the same person-day and part."""
    keyed = part_file_keys(files)
    motion = keyed.where("kind = 'motion'").select("person_day", "part", F.col("file_name").alias("motion_file"))
    ranges = keyed.where("kind = 'range'").select("person_day", "part", F.col("file_name").alias("range_file"))
    return motion.join(ranges, ["person_day", "part"])
