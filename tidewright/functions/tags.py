"""Parsing and checking of quality, difficulty and category tags written by a model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import strip_fences

# The key each tagging task answers with, and the closed value lists.
TAG_KEYS = {"quality": "input_quality", "sample_quality": "score", "difficulty": "difficulty", "classification": "primary_tag"}
QUALITIES = ["very poor", "poor", "average", "good", "excellent"]
DIFFICULTIES = ["very easy", "easy", "medium", "hard", "very hard"]
SCORES = ["1", "2", "3", "4", "5"]
TAG_VALUES = {"quality": QUALITIES, "sample_quality": SCORES, "difficulty": DIFFICULTIES}


def _salvaged(response: Column, key: str) -> Column:
    """Value of a key in text that is not JSON; the word None when it is not there."""
    if key == "score":
        digit = F.regexp_extract(response, '"score":\\s*"?\\[?"?(\\d+)', 1)
        quoted = F.regexp_extract(response, '"score":\\s*"(.*)"', 1)
        hit = F.when(digit != "", digit).otherwise(quoted)
    else:
        hit = F.regexp_extract(response, f'"{key}":\\s*"([\\w\\s]*)"', 1)
    return F.when(hit != "", hit).otherwise(F.lit("None"))


def _nearest(value: Column, words) -> Column:
    """A free tag reduced to a listed one: first element of a list, last digit, or last listed word."""
    listed = F.regexp_extract(value, "\\[\\s*[\"']?([^\\]\"',]+)", 1)
    digit = F.regexp_extract(value, ".*(\\d+)", 1)
    word = F.regexp_extract(value, ".*(" + "|".join([*QUALITIES, *DIFFICULTIES]) + ").*", 1)
    whole = F.regexp_extract(value, "^(\\d+)(?:\\.\\d+)?$", 1)
    loose = (
        F.when(listed != "", F.trim(listed)).when(whole != "", whole).when(digit != "", digit).when(word != "", word).otherwise(value)
    )
    return F.when(value.isin(words), value).otherwise(loose)


def parse_tag(df: DataFrame, response: str, task: str) -> DataFrame:
    """Add ``tag``, ``explanation``, ``tag_error`` and ``tag_raw`` for one tagging task."""
    key = TAG_KEYS[task]
    text = strip_fences(response)
    parsed = F.try_parse_json(text)
    top = F.coalesce(F.try_variant_get(parsed, "$[0]", "variant"), parsed)
    found = F.try_variant_get(top, f"$.{key}", "string")
    raw = F.coalesce(found, _salvaged(text, key))
    tag = _nearest(raw, TAG_VALUES.get(task, []))
    if task == "sample_quality":
        tag = F.when(tag.rlike("^\\d+$"), tag)
    if task == "classification":
        tag = raw
    told = F.try_variant_get(top, "$.explanation", "string")
    why = F.when(parsed.isNull(), text).otherwise(told)
    out = df.withColumn("tag", tag).withColumn("explanation", F.when(F.col("tag").isNotNull(), why))
    return out.withColumns(
        {
            "tag_error": F.when(F.col("tag").isNull(), F.lit(f"Failed to rate for {task} task")),
            "tag_raw": F.when(F.col("tag").isNull(), F.col(response)),
        }
    )


def parse_difficulty(df: DataFrame, response: str) -> DataFrame:
    """Difficulty rating with intent and knowledge."""
    parsed = F.try_parse_json(strip_fences(response))
    fields = {n: F.try_variant_get(parsed, f"$.{n}", "string") for n in ("intent", "knowledge")}
    return parse_tag(df, response, "difficulty").withColumns(fields)


def first_label(tags) -> Column:
    """Last entry of the first model's map in a list of ``{model: label}`` maps."""
    return F.element_at(F.map_values(F.get(tags, F.lit(0))), -1)


def score_reason(quality="input_quality", difficulty="difficulty", score="judge_quality_score", category="task_category") -> Column:
    """First tag outside its closed list, NULL when all are fine; an absent (NULL) tag column is not checked."""
    return (
        F.when(~F.col(quality).isin(QUALITIES), "input_quality")
        .when(~F.col(difficulty).isin(DIFFICULTIES), "difficulty")
        .when(~F.col(score).isin(SCORES), "judge_quality_score")
        .when(F.length(category) < 1, "task_category")
    )


def gate_reason(
    remove_duplicates=True, quality=("good", "excellent"), scores=("5",), difficulty=tuple(DIFFICULTIES), id="id", similar="min_similar_id"
) -> Column:
    """Why a tagged row fails the quality gate, NULL when it passes."""
    reason = (
        F.when(~F.col("input_quality").isin(list(quality)), "input quality")
        .when(~F.col("judge_quality_score").isin(list(scores)), "judge quality")
        .when(~F.col("difficulty").isin(list(difficulty)), "difficulty")
    )
    if remove_duplicates:
        reason = reason.when(F.col(similar).isNotNull() & (F.col(id) != F.col(similar)), "duplicate")
    return reason


def filter_tagged(df: DataFrame, filter_type, **criteria) -> DataFrame:
    """Add ``reason`` for the checks named by ``filter_type`` (one name or several)."""
    kinds = {filter_type} if isinstance(filter_type, str) else set(filter_type)
    checks = []
    if kinds & {"invalid_scores", "all"}:
        checks.append(score_reason())
    if kinds & {"high_quality_filter", "all"}:
        checks.append(gate_reason(**criteria))
    return df.withColumn("reason", F.coalesce(*checks))


def collate_tags(rows: DataFrame, id: str, task="task", tag="tag") -> DataFrame:
    """One map of task to tag per input row."""
    return rows.groupBy(id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(task, tag)))).alias("tags"))
