"""Checks of tool calls written as JSON against the tools a row offers.

``answer`` holds a JSON list of ``{"name", "arguments", "id"}`` objects; ``tools`` is
``array<struct<name: string, required: array<string>, types: map<string, string>>>``. Each check is an expression, and the first
one that fails names the reason.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import tolerant_json

# Keys a call may have, words of small numbers, and argument types whose values need not be said.
CALL_KEYS = ["name", "arguments", "id"]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
]
IGNORED_TYPES = ["boolean"]


def plain(text) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), "[^a-z0-9]", "")


def _parsed(df: DataFrame, answer: str) -> DataFrame:
    calls = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    whole = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    call = lambda v: F.struct(
        v.alias("raw"), F.try_variant_get(v, "$.name", "string").alias("name"), F.try_variant_get(v, "$.id", "string").alias("id"),
        F.try_variant_get(v, "$.arguments", "map<string,variant>").alias("arguments"),
        F.try_variant_get(v, "$.arguments", "variant").isNotNull().alias("has_arguments"),
        F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")).alias("keys"), F.to_json(v).alias("text"),
    )
    df = df.withColumn("_v", tolerant_json(answer)).withColumn("_list", calls)
    df = df.withColumn("_well", F.coalesce(F.forall("_list", whole), F.lit(False)))
    return df.withColumn("_calls", F.when(F.col("_well"), F.transform("_list", call)))


LEAVES = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|-?[0-9][0-9.eE+-]*|true|false|null'


def _spoken(text: Column) -> Column:
    """Lower-case letters, digits and blanks; the text itself when none is left."""
    kept = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N} ]", ""))
    return F.when(kept == "", F.lower(text)).otherwise(kept)


def said_in(value: Column, question: Column) -> Column:
    """Whether every leaf of a JSON value, or the word of a small number, occurs in the question; keys don't count."""
    words = F.array(*[F.lit(w) for w in NUMBER_WORDS])

    def leaf(piece):
        quoted = F.startswith(piece, F.lit('"'))
        plain_text = F.when(quoted, F.try_variant_get(F.try_parse_json(piece), "$", "string")).otherwise(piece)
        word = F.get(words, F.when(~quoted, piece).try_cast("int"))
        return F.contains(question, plain_text) | F.contains(_spoken(question), _spoken(plain_text)) | F.coalesce(F.contains(_spoken(question), word), F.lit(False))

    leaves = F.filter(F.regexp_extract_all(F.to_json(value), F.lit(LEAVES), F.lit(0)), lambda p: ~F.endswith(p, F.lit(":")))
    return F.forall(leaves, leaf)


def is_date(text: Column) -> Column:
    """Whether a text reads as a date or a time of day."""
    shapes = r"^\s*(\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?|\d{1,2}:\d{2}(:\d{2})?|(\d{1,2}\s+)?(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?(\s+\d{1,2})?(,?\s+\d{4})?)\s*$"
    return F.coalesce((F.length(text) < 50) & (text.rlike(shapes) | text.try_cast("timestamp").isNotNull()), F.lit(False))


def check_calls(
    df: DataFrame, answer="answer", tools="tools", question="question", check_overlap=True, require_nested=False, allow_nested=False,
    multi_output=False, validate_question=True, ignore_types=tuple(IGNORED_TYPES),
) -> DataFrame:
    """Add ``reason`` (NULL when all calls are valid) and ``is_valid``."""
    q, known = F.coalesce(F.col(question), F.lit("")), F.transform(tools, lambda t: t["name"])
    rows = _parsed(df, answer).withColumn("_names", known)
    calls = F.col("_calls")
    tool = lambda c: F.get(F.filter(tools, lambda t: t["name"] == c["name"]), F.lit(0))
    texts, ids = F.transform(calls, lambda c: c["text"]), F.filter(F.transform(calls, lambda c: c["id"]), lambda i: i.isNotNull())
    question_words = F.transform(F.split(q, "\\s+"), plain)
    leaks = F.exists("_names", lambda n: F.array_contains(question_words, plain(n)) | (F.contains(q, F.lit("{")) & (F.contains(q, F.lit('name": ')) | F.contains(q, F.concat(n, F.lit('": '))))))

    value = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    refers = lambda v, group: F.exists(group, lambda o: o["id"].isNotNull() & (F.startswith(value(v), F.concat(o["id"], F.lit("."))) | (value(v) == o["id"])))
    mentions = lambda v, group: F.exists(group, lambda o: o["id"].isNotNull() & F.contains(value(v), o["id"]))
    earlier = lambda i: F.slice(calls, F.lit(1), i)
    later = lambda i: F.slice(calls, i + 1, F.size(calls))
    entries = lambda c: F.coalesce(F.map_entries(c["arguments"]), F.array().cast("array<struct<key:string,value:variant>>"))

    def typed(c, e):
        kind, shape = tool(c)["types"][e["key"]], F.schema_of_variant(e["value"])
        fits = (
            F.when(kind == "string", shape == "STRING").when(kind == "integer", shape == "BIGINT").when(kind == "boolean", shape == "BOOLEAN")
            .when(kind == "number", shape.rlike("^(BIGINT|DOUBLE|DECIMAL)")).when(kind == "array", F.startswith(shape, F.lit("ARRAY")))
            .when(kind == "object", F.startswith(shape, F.lit("OBJECT")))
        )
        return F.coalesce(fits, F.lit(True))

    def verdict(c, i):
        es = entries(c)
        missing = F.size(F.array_except(tool(c)["required"], F.map_keys(c["arguments"]))) > 0
        wrong_type = F.exists(es, lambda e: ~typed(c, e) & ~(F.lit(allow_nested or require_nested) & mentions(e["value"], calls)))
        unnamed = F.exists(es, lambda e: tool(c)["types"][e["key"]].isNull())
        future = F.exists(es, lambda e: refers(e["value"], later(i)))
        unsaid = F.exists(
            es,
            lambda e: ~refers(e["value"], earlier(i)) & ~tool(c)["types"][e["key"]].isin(list(ignore_types)) & ~(F.lit("date" in ignore_types) & is_date(value(e["value"]))) & ~said_in(e["value"], q),
        )
        indirect = F.exists(es, lambda e: ~refers(e["value"], earlier(i)) & mentions(e["value"], calls))
        reason = (
            F.when(F.size(F.array_except(c["keys"], F.array(*[F.lit(k) for k in CALL_KEYS]))) > 0, "additional keys")
            .when(c["name"].isNull() | ~c["has_arguments"], "missing mandatory fields")
            .when(c["arguments"].isNull(), "malformed arguments")
            .when(missing | wrong_type, "parameter validation")
            .when(unnamed, "unknown argument name")
            .when(future, "future reference")
        )
        if check_overlap:
            reason = reason.when(unsaid, "argument value not in question")
        return reason.when(indirect, "indirect reference")

    rows = rows.withColumn("_first", F.get(F.filter(F.transform(calls, verdict), lambda r: r.isNotNull()), F.lit(0)))
    nested = F.exists(F.transform(calls, lambda c, i: F.exists(entries(c), lambda e: refers(e["value"], earlier(i)))), lambda b: b)
    allowed = require_nested or allow_nested
    reason = F.when(F.col("_v").isNull(), "not parsed").when(~F.col("_well"), "malformed").when(
        (F.size(F.array_distinct(texts)) < F.size(texts)) | (F.size(F.array_distinct(ids)) < F.size(ids)), "duplicate calls"
    )
    if validate_question:
        reason = reason.when(leaks, "question names a tool")
    if multi_output:
        reason = reason.when(F.size(F.array_distinct(texts)) <= 1, "several calls expected")
    reason = reason.when(F.exists(calls, lambda c: c["name"].isNotNull() & ~F.array_contains("_names", c["name"])), "unknown tool")
    reason = reason.when(F.col("_first").isNotNull(), F.col("_first")).when(nested & F.lit(not allowed), "nested reference").when(~nested & F.lit(require_nested), "nested reference")
    judged = rows.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
    return judged.drop("_v", "_list", "_well", "_calls", "_names", "_first")
