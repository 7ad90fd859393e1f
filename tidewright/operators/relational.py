"""Row shaping, validation contracts, look-ups, sampling and set operations."""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.draws import draw, uniform
from tidewright.operators.scan import chunk_of, scan


def map_fields(df: DataFrame, mapping: dict) -> DataFrame:
    """Select and rename by ``{source: target}``; ``{"*": "*"}`` keeps the rest. Missing sources fail analysis.

    A dotted target builds a struct, a dotted source reads from one.
    """
    renames = {s: d for s, d in mapping.items() if s != "*"}
    keep = [F.col(c) for c in df.columns if "*" in mapping and c not in renames and c not in renames.values()]
    flat = [F.col(s).alias(d) for s, d in renames.items() if "." not in d]
    nested = {}
    for source, target in renames.items():
        if "." in target:
            parent, leaf = target.split(".", 1)
            nested.setdefault(parent, []).append(F.col(source).alias(leaf))
    return df.select(*keep, *flat, *[F.struct(*parts).alias(p) for p, parts in nested.items()])


def get_path(path: str) -> Column:
    """Column for ``a.b[1].c``, with ``[:n]`` for the first and ``[n:]`` for the items from n on."""
    out = None
    for step in path.split("."):
        name, *indexes = step.replace("]", "").split("[")
        out = F.col(name) if out is None else out.getField(name)
        for index in indexes:
            if index.startswith(":"):
                out = F.slice(out, 1, int(index[1:]))
            elif index.endswith(":"):
                out = F.slice(out, int(index[:-1]) + 1, 2_000_000_000)
            else:
                out = F.get(out, F.lit(int(index)))
    return out


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Write ``value`` at ``a.b[1].c``; missing parents are created and an array grows with NULLs up to the index."""
    steps = [int(x[1:-1]) if x.startswith("[") else x for x in re.findall(r"[^.\[\]]+|\[\d+\]", path)]
    known = df.schema[steps[0]].dataType if steps[0] in df.columns else None
    return df.withColumn(steps[0], _put(F.col(steps[0]) if known is not None else None, known, steps[1:], value))


def _put(base, dtype, steps, value: Column) -> Column:
    """``base`` (None when absent) with ``value`` at the end of ``steps``: names for fields, numbers for items."""
    if not steps:
        return value
    step, more = steps[0], steps[1:]
    if isinstance(step, int):
        if not isinstance(dtype, T.ArrayType):
            item = _put(None, None, more, value)
            return F.transform(F.sequence(F.lit(0), F.lit(step)), lambda i: F.when(i == step, item))
        last = F.greatest(F.coalesce(F.size(base), F.lit(0)) - 1, F.lit(step))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i == step, _put(F.get(base, i), dtype.elementType, more, value)).otherwise(F.get(base, i)))
    if not isinstance(dtype, T.StructType):
        return F.struct(_put(None, None, more, value).alias(step))
    inner = dtype[step].dataType if step in dtype.fieldNames() else None
    new = _put(base.getField(step) if inner is not None else None, inner, more, value)
    fields = [new.alias(f) if f == step else base.getField(f).alias(f) for f in dtype.fieldNames()]
    return F.struct(*fields, *([] if inner is not None else [new.alias(step)]))


def copy_fields(df: DataFrame, mapping: dict) -> DataFrame:
    """Copy ``{source: target}``; every read sees the old row."""
    return df.withColumns({target: F.col(source) for source, target in mapping.items()})


def apply_block(df: DataFrame, block, input_map=None, output_map=None, required=()) -> DataFrame:
    """Run ``block(df) -> df`` under renamed inputs and rename its outputs back.

    Columns the block does not name pass through. A missing required input raises.
    """
    input_map, output_map = dict(input_map or {}), dict(output_map or {})
    inside = df.withColumns({inner: F.col(outer) for outer, inner in input_map.items()})
    missing = [c for c in required if c not in inside.columns]
    if missing:
        raise ValueError(f"block inputs are missing: {missing}")
    result = block(inside)
    extra = [inner for outer, inner in input_map.items() if inner not in df.columns and inner not in output_map]
    return result.withColumnsRenamed(output_map).drop(*extra)


def flatten_field(df: DataFrame, field: str) -> DataFrame:
    """One row per list element; a scalar gives one row, an empty list none."""
    if df.schema[field].dataType.typeName() != "array":
        return df
    return df.withColumn(field, F.explode(field))


class _Flattened:
    """One row per list element, with a number that runs on over the rows of a partition."""

    def __init__(self):
        self.no = 0

    @staticmethod
    def analyze(table, field):
        from pyspark.sql.udtf import AnalyzeResult

        fields = [T.StructField(f.name, f.dataType.elementType if f.name == field.value and isinstance(f.dataType, T.ArrayType) else f.dataType) for f in table.dataType]
        return AnalyzeResult(schema=T.StructType([*fields, T.StructField("element_no", T.LongType())]))

    def eval(self, row, field):
        values = row[field]
        for value in values if isinstance(values, list) else [] if values is None else [values]:
            self.no += 1
            yield *[value if name == field else row[name] for name in row.__fields__], self.no


def register_flatten(spark) -> None:
    """The table function ``flatten_rows(TABLE(...) PARTITION BY ... ORDER BY (...), field)`` for SQL.

    Unlike ``explode`` it numbers the elements over all rows of a partition, in their order; a scalar gives one row, an empty
    or missing list none.
    """
    spark.udtf.register("flatten_rows", F.udtf(_Flattened))


class _Questions:
    """Numbered questions of one response: the lines that end with a question mark, without bullets and numbers."""

    def eval(self, response: str):
        lines = [line.strip().lstrip("-*0123456789.) ").strip() for line in (response or "").split("\n")]
        for no, line in enumerate([line for line in lines if line.endswith("?")], 1):
            yield no, line


def register_questions(spark) -> None:
    """The table function ``response_questions(text)`` for lateral joins: ``(question_no, question)`` of one response."""
    spark.udtf.register("response_questions", F.udtf(_Questions, returnType="question_no int, question string"))


def first_failed(criteria: dict) -> Column:
    """Name of the first criterion that a row fails, NULL when it passes all. Unknown counts as failed."""
    out = None
    for name, ok in criteria.items():
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, F.lit(name)) if out is None else out.when(failed, F.lit(name))
    return out


def split_valid(df: DataFrame, reason: Column, keep_all=False):
    """``(kept, rejected)`` frames with ``is_valid`` and ``reason`` columns."""
    judged = df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
    return (judged if keep_all else judged.where("is_valid")), judged.where("NOT is_valid")


def to_schema(df: DataFrame, names) -> DataFrame:
    """Only the columns of the output type, in its order."""
    return df.select(*names)


def latest(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the one with the highest ``order``, ties by the whole row; partial aggregation keeps hot keys cheap."""
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *rest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def earliest(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the one with the lowest ``order``."""
    keys, order = list(keys), [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def with_cache(requests: DataFrame, cache: DataFrame, columns):
    """``(hits, misses)``: requests with a cached response by the hash of their columns, and those without."""
    key = F.sha2(F.to_json(F.struct(*columns)), 256)
    keyed = requests.withColumn("request_key", key)
    hits = keyed.join(cache.select("request_key", "response"), "request_key")
    misses = keyed.join(cache.select("request_key"), "request_key", "left_anti")
    return hits, misses


def per_task(df: DataFrame, tasks: dict) -> DataFrame:
    """Each row once per task whose applicability holds, from a literal task list (no join)."""
    named = F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tasks.items()])
    return df.withColumn("task", F.explode(F.filter(named, lambda t: t.isNotNull())))


def example_groups(seeds: DataFrame, task: str, id: str, size: int, seed=0) -> DataFrame:
    """Shuffled groups of ``size`` examples per task, as ``(task, group_no, examples)``."""
    shuffled = seeds.withColumn("_d", draw(seed, F.col(id))).withColumn("_one", F.lit(1))
    ranked = scan(shuffled, [task], ["_d", id], F.shiftright("_d", 20), cumsum={"_rank": "_one"})
    grouped = ranked.withColumn("group_no", F.floor((F.col("_rank") - 1) / size).cast("bigint"))
    fields = [c for c in seeds.columns if c != task]
    return grouped.groupBy(task, "group_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*fields).alias("e")))), lambda s: s["e"]).alias("examples")
    )


def few_shot(docs: DataFrame, groups: DataFrame, task: str) -> DataFrame:
    """Every document with every example group of its task."""
    return docs.join(groups, task)


def few_shot_drawn(docs: DataFrame, groups: DataFrame, task: str, id: str, per_doc=1, seed=0) -> DataFrame:
    """Every document with ``per_doc`` drawn example groups of its task (all of them when there are fewer).

    Draws start at a group that a hash of the document picks and go on round the task's groups, so rows grow with the documents
    and not with documents times groups. ``groups(task, group_no, examples)`` number the groups of a task from 0.
    """
    sizes = groups.groupBy(task).agg(F.count("*").alias("_n"))
    start = F.pmod(draw(seed, F.col(id)), F.col("_n"))
    many = F.least(F.lit(per_doc), F.col("_n")).cast("int")
    asked = docs.join(sizes, task).withColumn("_k", F.explode(F.sequence(F.lit(0), many - 1))).withColumn("group_no", F.pmod(start + F.col("_k"), F.col("_n")))
    return asked.join(groups, [task, "group_no"]).drop("_n", "_k")


def request_batches(df: DataFrame, params, id: str, size: int, chunk_rows=100_000) -> DataFrame:
    """Cut each parameter group into batches of ``size`` in id order."""
    ranked = scan(df.withColumn("_one", F.lit(1)), params, id, chunk_of(id, chunk_rows), cumsum={"_rank": "_one"})
    return ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / size).cast("bigint")).drop("_one", "_rank")


def sample_rows(df: DataFrame, id: str, n: int, seed=0) -> DataFrame:
    """``n`` random rows without replacement, the same in every run."""
    return df.orderBy(draw(seed, F.col(id)), id).limit(n)


def next_batch(seeds: DataFrame, machine: DataFrame, id: str, after, n_seed: int, n_machine: int, seed=0) -> DataFrame:
    """The next seed rows in id order with a few random machine rows.

    ``after`` is the last seed id of the batch before, NULL for the first one: a batch late in the table costs no more than an
    early one, as ids up to there are filtered at the scan.
    """
    left = seeds if after is None else seeds.where(F.col(id) > F.lit(after))
    head = left.orderBy(id).limit(n_seed).withColumn("is_seed", F.lit(True))
    return head.unionByName(sample_rows(machine, id, n_machine, seed).withColumn("is_seed", F.lit(False)))


def shuffle(df: DataFrame, id: str, seed=0) -> DataFrame:
    return df.orderBy(draw(seed, F.col(id)), id)


def split_share(df: DataFrame, id: str, share=0.8, seed=0):
    """``(train, rest)`` by a threshold on the row's draw; a row never changes sides."""
    u = uniform(seed, F.col(id))
    return df.where(u < share), df.where(u >= share)


def sample_columns(df: DataFrame, ids, prefix: str, n: int, seed=0) -> DataFrame:
    """``n`` random columns with a name prefix as long rows; needs strictly more than ``n`` of them."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if len(names) <= n:
        raise ValueError(f"{len(names)} columns start with {prefix}, more than {n} are needed")
    from random import Random

    return df.unpivot(list(ids), sorted(Random(seed).sample(names, n)), "channel", "value")


def balanced(df: DataFrame, label: str, id: str, per_label: int, seed=0) -> DataFrame:
    """``per_label`` random rows of each label; a threshold draw thins hot labels before the exact cut."""
    drawn = df.withColumn("_d", draw(seed, F.col(id)))
    parts = F.pmod(F.col("_d"), F.lit(64))
    near = Window.partitionBy(label, parts).orderBy("_d", id)
    local = drawn.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= per_label)
    whole = Window.partitionBy(label).orderBy("_d", id)
    return local.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= per_label).drop("_d", "_r")


def distinct_rounded(df: DataFrame, values, batch: str, id: str, digits=3) -> DataFrame:
    """Rows that are new after rounding; the earliest batch keeps its row."""
    rounded = df.withColumns({c: F.round(c, digits) for c in values})
    return earliest(rounded, values, [batch, id])


def concat_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns missing in one of them are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_since(now: DataFrame, before: DataFrame, id: str) -> DataFrame:
    """First and last of the items that the snapshot did not have, with their number."""
    fresh = now.select(id).distinct().join(before.select(id), id, "left_anti")
    return fresh.agg(F.min(id).alias("first_new"), F.max(id).alias("last_new"), F.count("*").alias("n_new"))


def has_duplicates(array) -> Column:
    return F.size(F.array_distinct(array)) < F.size(array)


def is_subset(used, available) -> Column:
    return F.size(F.array_except(used, available)) == 0


def common_to_all(lists) -> Column:
    """Elements that every list of an array of lists has."""
    return F.aggregate(F.slice(lists, 2, 2_000_000_000), F.get(lists, F.lit(0)), lambda a, x: F.array_intersect(a, x))


def set_f1(answer, label) -> Column:
    """F1 of two sets given as arrays; 0 when both are empty."""
    both = F.size(F.array_intersect(answer, label))
    total = F.size(F.array_distinct(answer)) + F.size(F.array_distinct(label))
    return F.when(total > 0, 2.0 * both / total).otherwise(0.0)


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Row counts per key before and after a step."""
    sides = before.select(key, F.lit(1).alias("_b"), F.lit(0).alias("_a")).unionByName(
        after.select(key, F.lit(0).alias("_b"), F.lit(1).alias("_a"))
    )
    return sides.groupBy(key).agg(F.sum("_b").alias("n_before"), F.sum("_a").alias("n_after"))
