"""Answer evaluation reports and routine format checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import numbered_answers
from tidewright.operators.relational import latest


def answer_rows(samples: DataFrame, answers: DataFrame, order="part_no") -> DataFrame:
    """One row per question with its own answer; a sample without an answer gets empty ones.

    ``samples(idx, abilities: array<string>, ...)``, ``answers(idx, part_no, response)``; a later part wins.
    """
    last = latest(answers.select("idx", order, "response"), ["idx"], order).select("idx", "response")
    joined = samples.join(last, "idx", "left").withColumn("response", F.coalesce("response", F.lit("")))
    split = joined.withColumn("_a", numbered_answers("response", F.size("abilities"))).withColumn("_z", F.arrays_zip("abilities", "_a"))
    rows = split.select(*joined.columns, F.posexplode("_z").alias("question_no", "_q"))
    return rows.withColumns({"ability": F.col("_q.abilities"), "answer": F.col("_q._a")}).drop("_q", "abilities", "response")


def score_report(scores: DataFrame) -> DataFrame:
    """Mean score and count per kind and ability, and per kind over all abilities (ability NULL).

    ``scores(ability, score: struct<categorical, numerical, reason>)``.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"score.{k}").alias("v")) for k in ("categorical", "numerical", "reason")])
    long = scores.select("ability", F.explode(kinds).alias("s")).select("ability", "s.kind", F.explode("s.v").alias("value"))
    return long.groupingSets([["kind", "ability"], ["kind"]], "kind", "ability").agg(F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))


def token_total(answers: DataFrame, column="num_tokens") -> DataFrame:
    return answers.agg(F.sum(F.coalesce(column, F.lit(0))).alias("consumed_tokens"))


# How many objects each action takes.
ACTION_ARITY = {
    "walk": 1, "run": 1, "walktowards": 1, "walkforward": 0, "turnleft": 0, "turnright": 0, "sit": 1, "standup": 0,
    "grab": 1, "open": 1, "close": 1, "put": 2, "putin": 2, "switchon": 1, "switchoff": 1, "drink": 1, "touch": 1,
    "lookat": 1,
}


def arity(action: str) -> Column:
    """Number of objects an action takes, NULL for an unknown action."""
    out = F.lit(None).cast("int")
    for name, n in ACTION_ARITY.items():
        out = F.when(F.col(action) == name, n).otherwise(out)
    return out


def format_report(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per file: totals, wrong lines, missing and unknown actions, missing and misplaced objects, with percentages.

    ``lines(file, line_no, text, action, objects, room)`` are parsed step lines; ``allowed(room, object)`` is what may lie
    where. Room names are allowed everywhere. Blank lines aren't counted.
    """
    from tidewright.functions.labels import ROOMS

    missing = F.col("text") == "[]"
    hole, unknown = ~missing & F.contains("text", F.lit("<>")), ~missing & arity("action").isNull()
    flags = {"_missing": missing, "_hole": hole, "_unknown": unknown, "_arity": ~missing & ~unknown & (F.size("objects") != arity("action"))}
    rows = lines.where(F.trim("text") != "").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    each = rows.select("file", "line_no", "room", *flags, F.explode_outer(F.when(~F.col("_missing"), F.filter("objects", lambda o: o != ""))).alias("object"))
    known = allowed.select("room", "object").distinct().withColumn("_known", F.lit(True))
    judged = each.join(known, ["room", "object"], "left")
    misplaced = F.count_if(F.col("object").isNotNull() & ~F.col("object").isin(ROOMS) & F.col("_known").isNull())
    joined = judged.groupBy("file", "line_no", *flags).agg(misplaced.alias("_misplaced"), F.count("object").alias("_checked"))
    counts = joined.groupBy("file").agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("_missing") | F.col("_unknown") | F.col("_hole") | F.col("_arity") | (F.col("_misplaced") > 0)).alias("wrong_lines"),
        F.count_if("_arity").alias("invalid_format"),
        F.count_if("_missing").alias("missing_actions"),
        F.count_if("_unknown").alias("unknown_actions"),
        F.count_if("_hole").alias("missing_objects"),
        F.sum("_checked").alias("objects_checked"),
        F.sum("_misplaced").alias("misplaced_objects"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b) * 100, 6)).otherwise(0.0)
    return counts.withColumns(
        {"wrong_line_pct": share("wrong_lines", "total_lines"), "misplaced_object_pct": share("misplaced_objects", "objects_checked")}
    )
