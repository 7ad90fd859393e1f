"""Series encodings, embedding rows as text and back, padding and rounding of arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.draws import draw


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def array_mean(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x) / F.size(_c(a))


def encode(df: DataFrame, series: str, method="minmax_scale") -> DataFrame:
    """Add ``encoded``, ``prompt``, ``offset`` and ``scale_factor``.

    ``minmax_scale`` centres the series and divides by a third of its largest deviation when
    that reaches 3; ``sp`` also puts a 1 after each value; ``no`` leaves everything as it is.
    """
    if method == "no":
        nothing = F.lit(None).cast("double")
        return df.withColumns({"encoded": F.col(series), "prompt": F.lit("<ts><ts/>"), "offset": nothing, "scale_factor": nothing})
    if method not in ("minmax_scale", "sp"):
        raise ValueError(f"unknown encoding {method}")
    base = df.withColumn("_mean", array_mean(series))
    base = base.withColumn("_dev", F.transform(series, lambda x: x - F.col("_mean")))
    base = base.withColumn("_top", F.array_max(F.transform("_dev", F.abs)))
    base = base.withColumn("scale_factor", F.when(F.col("_top") >= 3.0, F.col("_top") / 3.0).otherwise(1.0))
    scaled = F.transform("_dev", lambda x: x / F.col("scale_factor"))
    if method == "sp":
        scaled = F.flatten(F.transform(scaled, lambda x: F.array(x, F.lit(1.0))))
    prompt = F.format_string("[Value Offset: %.4f|Value Scaling: %.4f]<ts><ts/>", -F.col("_mean"), F.col("scale_factor"))
    return base.withColumns({"encoded": scaled, "prompt": prompt, "offset": -F.col("_mean")}).drop("_mean", "_dev", "_top")


def pad(a, length) -> Column:
    """Zeros after the series up to ``length``."""
    return F.concat(_c(a), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), _c(length) - F.size(_c(a))).cast("int")))


def pad_batch(df: DataFrame, keys, series: str) -> DataFrame:
    """Pad every series to the longest of its batch."""
    longest = df.groupBy(*keys).agg(F.max(F.size(series)).alias("_longest"))
    return df.join(longest, list(keys)).withColumn(series, pad(series, F.col("_longest"))).drop("_longest")


def round_nested(a, digits=6, depth=1) -> Column:
    """Round the numbers of an array nested ``depth`` levels deep."""
    if depth == 0:
        return F.round(a, digits)
    return F.transform(_c(a), lambda x: round_nested(x, digits, depth - 1))


def norm(a, start=0, length=None) -> Column:
    """Euclidean length of a slice of an array."""
    part = _c(a) if length is None else F.slice(_c(a), start + 1, length)
    return F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x))


def row_to_text(columns, end="", template="fim_template", digits=4, numeric=None, shuffle_by=None, seed=0) -> Column:
    """A row of named values as one sentence; ``columns`` fixes their order unless ``shuffle_by`` names an id column.

    With an id every row has an order of its own, drawn by hash, which blanks and values share.
    """
    numeric = set(columns if numeric is None else numeric)
    shown = {c: F.format_string(f"%.{digits}f", c) if c in numeric else F.col(c).cast("string") for c in columns}

    def joined(names, separator, phrase):
        if shuffle_by is None:
            return F.concat_ws(separator, *[phrase(c) for c in names])
        keyed = F.array(*[F.struct(draw(seed, F.col(shuffle_by), i).alias("h"), F.lit(i).alias("i"), phrase(c).alias("v")) for i, c in enumerate(columns) if c in names])
        return F.concat_ws(separator, F.transform(F.array_sort(keyed), lambda k: k["v"]))

    is_value = lambda c: F.concat(F.lit(f"{c} is "), shown[c])
    blank, answer = (lambda c: F.lit(f"{c} is [blank]")), (lambda c: F.concat(shown[c], F.lit(" [answer]")))
    if template == "base_template":
        return F.concat(joined(columns, ", ", is_value), F.lit(end))
    if template == "fim_template":
        return F.concat(F.lit("Input: "), joined(columns, ", ", blank), F.lit(" [sep] Target: "), joined(columns, " ", answer), F.lit(end))
    if template != "fim_template_textual_encoding":
        raise ValueError(f"unknown template {template}")
    words, numbers = [c for c in columns if c not in numeric], [c for c in columns if c in numeric]
    return F.concat(F.lit("Condition: "), joined(words, ", ", is_value), F.lit(" [sep] Input: "), joined(numbers, ", ", blank), F.lit(" [sep] Target: "), joined(numbers, " ", answer), F.lit(end))


def text_to_row(df: DataFrame, text: str, columns, template="fim_template") -> DataFrame:
    """Numbers of generated sentences back in columns.

    Malformed sentences drop out, as does a sentence without the target mark; a sentence with
    fewer targets than inputs, and a value that is no number, leave NULLs.
    """
    t = F.regexp_replace(F.regexp_replace(F.col(text), "\n", " "), "\r", "")
    if template == "base_template":
        items = F.transform(F.split(t, ","), lambda f: F.split(F.trim(f), " is ", -1))
        rows = df.withColumn("_pairs", F.transform(items, lambda i: F.struct(F.get(i, F.lit(0)).alias("k"), F.get(i, F.lit(1)).alias("v"))))
    else:
        body = t
        if template == "fim_template_textual_encoding":
            halves = F.split(t, " \\[sep\\] Input: ", -1)
            df = df.where(F.size(halves) == 2).withColumn(
                "data", F.regexp_replace(F.get(halves, F.lit(0)), "^Condition: data is ", "")
            )
            body = F.get(halves, F.lit(1))
        parts = F.split(body, " \\[sep\\] Target: ", -1)
        asked = F.split(F.regexp_replace(F.get(parts, F.lit(0)), "^Input: ", ""), ",", -1)
        told = F.split(F.regexp_replace(F.get(parts, F.lit(1)), " \\[answer\\]$", ""), " \\[answer\\] ", -1)
        names = F.transform(asked, lambda f: F.get(F.split(F.trim(f), " is ", -1), F.lit(0)))
        pairs = F.zip_with(names, F.slice(told, F.lit(1), F.size(asked)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        empty = F.lit(None).cast("array<struct<k:string,v:string>>")
        rows = df.where(F.size(parts) == 2).withColumn("_pairs", F.when(F.size(told) >= F.size(asked), pairs).otherwise(empty))
    value = lambda c: F.get(F.filter("_pairs", lambda p: p["k"] == c), F.lit(0))["v"].try_cast("double")
    return rows.withColumns({c: value(c) for c in columns}).drop("_pairs", text)
