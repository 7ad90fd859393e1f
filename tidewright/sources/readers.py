"""File sources: text, JSON, JSON lines, YAML, CSV, Parquet, globs, inline rows and sensor logs."""

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators.relational import concat_all
from tidewright.operators.scan import scan

BAD = "_corrupt_record"


def read_text(spark: SparkSession, path) -> DataFrame:
    """One row per file, its whole text in ``content``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")


def read_jsonl(spark: SparkSession, path, schema=None):
    """``(rows, bad)``: one row per non-blank line, and the lines that are no JSON object."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        schema = spark.read.json(path, mode="DROPMALFORMED").schema
    parsed = lines.withColumn("_v", F.try_parse_json("value"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    wanted = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in schema if f.name != BAD)
    rows = parsed.where(is_object).select(F.try_variant_get("_v", "$", f"struct<{wanted}>").alias("r")).select("r.*")
    return rows, parsed.where(~is_object).select("value")


def read_json(spark: SparkSession, path, schema=None) -> DataFrame:
    """A list gives rows, an object one row, an unreadable file none. The file name stays in ``file_name``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
    named = rows.withColumn("file_name", F.col("_metadata.file_name"))
    return named.where(F.col(BAD).isNull()).drop(BAD) if BAD in rows.columns else named


def _flat_yaml(text: str) -> list[dict]:
    """Rows of flat YAML; raises on nested values, block scalars, flow collections, anchors and lines without a key."""
    rows, row, indent = [], {}, None
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or body.strip() in ("---", "..."):
            continue
        at = len(body) - len(body.lstrip())
        body = body.lstrip()
        if body == "-" or body.startswith("- "):
            if row:
                rows.append(row)
            row, indent = {}, None
            at, body = at + 2, body[2:].strip()
            if not body:
                continue
        key, colon, value = body.partition(":")
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        if not colon or (indent is not None and at != indent) or (value and not quoted and value[0] in "|>[{&*!"):
            raise ValueError(f"line {number} is not flat YAML: {line!r}")
        indent = at
        row[key.strip().strip("\"'")] = value[1:-1] if quoted else value or None
    return rows + [row] if row else rows


def read_yaml(spark: SparkSession, path, schema: str) -> DataFrame:
    """Flat YAML (a list of objects or one object of scalars) in the given columns, all strings; an empty value is NULL.

    What isn't flat fails the read: nested values, block scalars, flow collections, anchors.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def parse(batches):
        for pdf in batches:
            rows = [{n: r.get(n) for n in names} for text in pdf["value"] for r in _flat_yaml(text)]
            yield pd.DataFrame(rows, columns=names, dtype="object")

    return spark.read.text(path, wholetext=True).mapInPandas(parse, ", ".join(f"`{n}` string" for n in names))


def read_csv(spark: SparkSession, path, has_header=True, delimiter=",", quotechar='"', lineterminator=None, skipinitialspace=False) -> DataFrame:
    """All columns stay strings."""
    options = {"header": has_header, "sep": delimiter, "quote": quotechar, "ignoreLeadingWhiteSpace": skipinitialspace, "escape": quotechar}
    if lineterminator:
        options["lineSep"] = lineterminator
    return spark.read.csv(path, inferSchema=False, **options)


def read_parquet(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


READERS = {
    "txt": read_text, "md": read_text, "json": lambda s, p: read_json(s, p).drop("file_name"), "jsonl": lambda s, p: read_jsonl(s, p)[0], "csv": read_csv, "parquet": read_parquet,
}


def read_folder(spark: SparkSession, folder: str, formats=("json", "jsonl"), pattern="*") -> DataFrame:
    """All files of the named formats in a folder, one after another; missing columns are NULL.

    ``pattern`` is a glob below the folder without the extension: ``*/*`` for one level down, ``{,*/}run*`` for both.
    """
    frames = []
    for kind in formats:
        try:
            frames.append(READERS[kind](spark, f"{folder}/{pattern}.{kind}"))
        except Exception as error:  # no file of this format
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if not frames:
        raise FileNotFoundError(f"no {formats} files in {folder}")
    return concat_all(*frames)


def inline(spark: SparkSession, records) -> DataFrame:
    """A short literal list of records; keys may differ between records."""
    return spark.createDataFrame([json.loads(json.dumps(r)) for r in records])


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``(file, line_no, text)`` with true line numbers, for files whose order matters.

    Files are read by byte ranges, as Spark cuts them, so a large file fills many tasks. The lines of a range are counted, and
    a running total over the ranges of a file (one row each) turns the place inside a range into the line number.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"), "value",
    )
    ranges = lines.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select(F.col("_path").alias("_p"), F.col("_start").alias("_s"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = lines.join(starts, (F.col("_path") == F.col("_p")) & (F.col("_start") == F.col("_s")))
    text = F.when(F.endswith("value", F.lit("\r")), F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    return placed.select("file", (F.col("_at") - F.col("_first") + F.col("_before")).alias("line_no"), text.alias("text"))


# The columns of an activity log, in their order.
ACTIVITY_COLUMNS = [
    "timestamp", "activity_id", "heart_rate",
    "hand_temp", "hand_acc16_x", "hand_acc16_y", "hand_acc16_z", "hand_acc6_x", "hand_acc6_y", "hand_acc6_z", "hand_gyro_x", "hand_gyro_y",
    "hand_gyro_z", "hand_mag_x", "hand_mag_y", "hand_mag_z", "hand_orient_0", "hand_orient_1", "hand_orient_2", "hand_orient_3",
    "chest_temp", "chest_acc16_x", "chest_acc16_y", "chest_acc16_z", "chest_acc6_x", "chest_acc6_y", "chest_acc6_z", "chest_gyro_x", "chest_gyro_y",
    "chest_gyro_z", "chest_mag_x", "chest_mag_y", "chest_mag_z", "chest_orient_0", "chest_orient_1", "chest_orient_2", "chest_orient_3",
    "ankle_temp", "ankle_acc16_x", "ankle_acc16_y", "ankle_acc16_z", "ankle_acc6_x", "ankle_acc6_y", "ankle_acc6_z", "ankle_gyro_x", "ankle_gyro_y",
    "ankle_gyro_z", "ankle_mag_x", "ankle_mag_y", "ankle_mag_z", "ankle_orient_0", "ankle_orient_1", "ankle_orient_2", "ankle_orient_3",
]


def read_activity(spark: SparkSession, path) -> DataFrame:
    """White-space separated activity log with 54 named columns; a line of another width fails the read."""
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), "\\s+").alias("p"))
    n = len(ACTIVITY_COLUMNS)
    wide = F.when(F.size("p") == n, F.col("p")).otherwise(F.raise_error(F.lit(f"a line has not {n} columns")).cast("array<string>"))
    number = lambda i: F.when(F.lower(wide[i]) != "nan", wide[i].cast("double"))
    return parts.select(*[number(i).alias(c) for i, c in enumerate(ACTIVITY_COLUMNS)])


def active_rows(log: DataFrame, channels, min_rows=0, interpolate=False, chunk_seconds=10_000) -> DataFrame:
    """Rows of a known activity with the wanted channels as 32-bit floats.

    With ``interpolate`` gaps are filled along the rows in order of time: linear between known values, the nearest known
    value at the ends. Fewer than ``min_rows`` rows, or a channel without any value, raise.
    """
    rows = log.where("activity_id <> 0")
    if interpolate:
        order = ["timestamp"]
        chunk = F.floor(F.col("timestamp") / chunk_seconds).cast("bigint")
        rows = scan(rows.select("timestamp", *channels, F.lit(1).alias("_one")), [], order, chunk, cumsum={"_no": "_one"})
        point = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_no").alias("n"), F.col(c).alias("v"))) for c in channels}
        rows = rows.withColumns({f"_p_{c}": e for c, e in point.items()})
        rows = scan(rows, [], order, chunk, last={f"_l_{c}": f"_p_{c}" for c in channels}, next={f"_n_{c}": f"_p_{c}" for c in channels})

        def filled(c):
            a, b = F.col(f"_l_{c}"), F.col(f"_n_{c}")
            between = a["v"] + (b["v"] - a["v"]) * (F.col("_no") - a["n"]) / (b["n"] - a["n"])
            return F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)

        rows = rows.select("timestamp", *[filled(c).alias(c) for c in channels])
    if interpolate or min_rows:
        found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in channels]).first()
        if found["n"] < min_rows:
            raise ValueError(f"{found['n']} rows, at least {min_rows} are wanted")
        empty = [c for c in channels if interpolate and found[c]]
        if empty:
            raise ValueError(f"no values in {empty}")
    return rows.select("timestamp", *[F.col(c).cast("float") for c in channels])


def read_motion(spark: SparkSession, path, num_lines=None) -> DataFrame:
    """Motion log lines with at least seven fields and readable numbers, unique per sensor, position and frame."""
    lines = read_lines(spark, path)
    if num_lines is not None:
        lines = lines.where(F.col("line_no") < num_lines)
    p = F.split(F.trim("text"), "\\s+")
    rows = lines.where(F.size(p) >= 7).select(
        "file", "line_no", p[0].try_cast("int").alias("frame"), p[1].alias("character"), F.concat_ws(" ", p[1], p[2]).alias("sensor"), p[3].alias("room"),
        *[p[i].try_cast("double").alias(a) for i, a in ((4, "x"), (5, "y"), (6, "z"))],
    )
    good = rows.dropna(subset=["frame", "x", "y", "z"])
    keys = ["file", "sensor", "x", "y", "z", "frame"]
    first = good.groupBy(*keys).agg(F.min_by(F.struct("line_no", "character", "room"), "line_no").alias("r"))
    return first.select("file", "r.line_no", "frame", "r.character", "sensor", "r.room", "x", "y", "z")
