"""Whole jobs built from the operators. Model replies come from callables that add a column; everything else runs here."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import tags, text
from tidewright.operators import intervals, matrix, neighbours, routine, series, similarity
from tidewright.operators.relational import first_failed
from tidewright.operators.scan import chunk_of
from tidewright.session import durable

TAG_COLUMNS = {"quality": "input_quality", "sample_quality": "judge_quality_score", "difficulty": "difficulty", "classification": "task_category"}


def tag_and_filter(rows: DataFrame, id: str, vector: str, responses: dict, threshold: float, kinds="all", **criteria) -> DataFrame:
    """Tags out of ``responses`` (task -> column), the nearest earlier duplicate by ``vector``, and the quality gate.

    Returns ``rows`` + one column per tag, ``min_similar_id`` and ``reason`` (NULL: the row passes).
    """
    out = rows
    for task, column in responses.items():
        parsed = tags.parse_tag(out, column, task)
        out = parsed.withColumnRenamed("tag", TAG_COLUMNS[task]).drop("explanation", "tag_error", "tag_raw")
    twins = neighbours.duplicate_summary(rows.select(id, vector), id, vector, threshold).select(id, "min_similar_id")
    return tags.filter_tagged(out.join(twins, id, "left"), kinds, id=id, **criteria)


def knowledge_pairs(documents: DataFrame, column: str, size: int, short_tail: int, answer, judge) -> DataFrame:
    """Documents without references -> chunks -> replies -> question-answer pairs -> three named criteria in order.

    ``answer(chunks)`` adds ``reply``; ``judge(pairs, rule)`` returns a column with the judge's text. Returns the pairs
    with ``reason``: the first criterion that failed, NULL when all hold.
    """
    chunks = text.chunk_words(documents.withColumn(column, text.without_references(column)), column, size, short_tail)
    pairs = text.explode_qa(answer(chunks), "reply")
    criteria = {rule: F.coalesce(text.passes(rule, judge(pairs, rule)), F.lit(False)) for rule in ("faithful", "relevant", "verified")}
    return pairs.withColumn("reason", first_failed(criteria))


def skill_pairs(rows: DataFrame, ask, judge_question, answer, judge_answer) -> DataFrame:
    """Skill data: replies are cut into questions, good ones (rating 1) answered, good answers (above 1) kept.

    ``rows`` have ``context``, NULL for the free-form branch: with a context the questions share it, without one a reply
    is one question. ``ask`` adds ``reply``; the other callables return a column with a model's text. Rows that fail keep
    their ``reason``.
    """
    asked = ask(rows)
    blocks = F.when(F.col("context").isNotNull(), text.question_blocks("reply")).otherwise(F.array(text.trim_space(F.col("reply"))))
    questions = asked.select("*", F.posexplode(blocks).alias("question_no", "question")).drop("reply").where("question <> ''")
    questions = questions.withColumn("_asked", F.coalesce(text.passes("good_question", judge_question(questions)), F.lit(False)))
    answered = questions.withColumn("answer", F.when(F.col("_asked"), answer(questions)))
    good = F.coalesce(text.passes("good_answer", judge_answer(answered)), F.lit(False))
    reason = F.when(~F.col("_asked"), "question").when(~good, "answer")
    return answered.withColumn("reason", reason).drop("_asked")


def instruction_batch(replies: DataFrame, id: str, column: str, threshold: float, types=("n_1",), filter_invalids=True, context=None) -> DataFrame:
    """Replies -> instructions -> format rules -> similarity against the context and earlier instructions.

    Returns every parsed instruction with ``reason``: a format rule, ``similar``, or NULL when it is kept. Earlier means a
    lower (``id``, ``task_no``).
    """
    parsed = text.parse_instructions(replies.select(id, column), column)
    numbered = parsed.withColumn("_key", F.struct(F.col(id).alias("id"), F.col("task_no").alias("no")))
    fresh = numbered.where("reason IS NULL").select(F.col("_key").alias("id"), F.col("instruction").alias("text"))
    told = similarity.similarity_dedup(fresh, context, threshold, types, filter_invalids=filter_invalids)
    joined = numbered.join(told.select(F.col("id").alias("_key"), "is_valid"), "_key", "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(~F.col("is_valid"), "similar"))).drop("_key", "is_valid")


def routine_job(lines: DataFrame, ground, fixes: DataFrame, labels: DataFrame, part_size=4, chunk_lines=routine.CHUNK_LINES):
    """Routine lines -> steps -> grounded -> repaired -> labelled, and the parts of each file.

    ``lines(file, line_no, text)``; ``ground(steps)`` replaces ``text`` by its grounded form; ``fixes(file, block_no, line_no,
    text)`` mend broken steps; ``labels(activity, ...)``. Lines before the first activity are a block without a name. Returns ``(steps, report, parts)``: labelled steps of files whose
    activities and blocks agree, every step that needed a fix, and ``(file, part, n_blocks, room)``.
    """
    parsed = durable(routine.parse_routine(lines, chunk_lines))
    grounded = routine.parse_steps(ground(parsed).select("file", "block_no", "line_no", "text"))
    repaired, report = routine.repair_steps(grounded, parsed, fixes)
    names = parsed.where("block_no > 0").groupBy("file", "block_no").agg(F.min_by("activity", "line_no").alias("activity"), F.min("line_no").alias("line_no"))
    steps = routine.label_blocks(repaired, names.select("file", "line_no", "activity"), labels)
    blocks = repaired.groupBy("file", "block_no").agg(F.max_by("text", "line_no").alias("text"))
    return steps, report, routine.block_parts(blocks, part_size)


def sensor_job(motion: DataFrame, ranges: DataFrame, key: str, gap=20, more_than=2, width=1000, chunk_rows=100_000) -> DataFrame:
    """Motion rows -> ON/OFF transitions; label ranges -> runs; transitions of runs that hold enough of them, packed.

    ``motion(key, sensor, frame, x, y, z)``; ``ranges(key, line_no, label, start, end)``. Returns one row per run with more than
    ``more_than`` transitions: ``(key, run_id, label, times, sensors, states)``.
    """
    turns = intervals.transitions(intervals.active_intervals(motion, [key, "sensor"], gap=gap, chunk_frames=chunk_rows), [key, "sensor"])
    runs = intervals.collapse_runs(ranges, [key], "line_no", "label", chunk_of("line_no", chunk_rows))
    placed = durable(intervals.interval_join(turns, runs, [key], "frame", width=width))
    names = [key, "run_id", "label"]
    dense = intervals.dense_segments(placed, names, "frame", more_than).drop("n_events")
    return intervals.pack_segments(placed.join(dense, names, "left_semi"), names)


def _accepted(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # nothing accepted yet
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def series_synthesis(
    observations: DataFrame, key: str, path: str, make_batch, wanted: int, min_points=200, min_windows=5, split="maximize-overlap",
    variance=0.7, dim="auto", threshold=0.5, stall=3, fence=3.0, most_rounds=100,
) -> DataFrame:
    """Observed series with gaps -> new series: ``(channel, round, id, x)``, a window of values per channel and accepted row.

    ``observations(key, t, value)`` are gap-filled, cut into windows of a length that the most frequent period gives, scaled by
    position and embedded by their principal components. A row stands for one window: the scores of all channels side by
    side. ``make_batch(number, rows)`` returns new rows ``(id, z)`` from the given ones. Of a batch, rows are accepted that are complete,
    new after rounding to three digits, and whose length in every channel lies in the quartile fence of all rows accepted so
    far, and are appended to the table at ``path``. A restarted job goes on after its last round. It stops with more than
    ``wanted`` rows and a diversity below ``threshold``, or after ``stall`` rounds without a new row; then every accepted row is turned
    back into values.
    """
    spark = observations.sparkSession
    filled = series.interpolate(series.on_full_grid(observations, [key]), [key])
    first = filled.groupBy(key).agg(F.min("t").alias("_t0"))
    filled = durable(filled.join(first, key).select(key, (F.col("t") - F.col("_t0")).alias("t"), F.col("filled").alias("value")))
    length = filled.groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if length is None:
        raise ValueError("there are no observations")
    periods = series.choose_period(filled, [key], length, min_points, min_windows)
    period = series.most_frequent_period(periods, key).first()["period"]
    window = period * max(1, -(-min_points // period))
    cut = series.cut_windows(filled, [key], None, period, window, min_windows, split)
    fit = durable(series.fit_scaler(cut, [key]))
    windows = durable(matrix.pack_windows(series.scale(cut, fit, [key]).withColumnRenamed(key, "channel")))
    parts = durable(matrix.components(matrix.gram(windows)))
    sizes = durable(matrix.embedding_sizes(parts, variance, dim))
    lead = durable(matrix.basis(parts, sizes))
    dims = [(r["channel"], r["k"]) for r in sizes.orderBy("channel").collect()]  # one row per channel
    scores = matrix.embed(windows, lead).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("channel", "z"))).alias("r"))
    width = sum(k for _, k in dims)
    side = F.flatten(F.transform("r", lambda s: s["z"]))
    original = durable(scores.where(F.size("r") == len(dims)).select(F.col("window").alias("id"), side.alias("z")))
    lengths = lambda df: matrix.split_norm_rows(df, "id", "z", [k for _, k in dims])
    ours = durable(lengths(original).drop("id"))
    quiet, number = 0, 0
    held = _accepted(spark, path)
    total = held.count() if held is not None else 0
    if total:
        number = held.agg(F.max("round")).first()[0] + 1
    while number < most_rounds:
        norms = ours if held is None else ours.unionByName(lengths(held).drop("id"))
        if total > wanted and matrix.norm_diversity(norms).agg(F.max("diversity")).first()[0] < threshold:
            break
        whole_rows = (F.size("z") == width) & F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))
        batch = make_batch(number, original).select("id", "z").where(whole_rows).withColumn("z", F.transform("z", lambda v: F.round(v, 3)))
        fresh = batch.groupBy("z").agg(F.min("id").alias("id"))
        if held is not None:
            fresh = fresh.join(held.select("z"), "z", "left_anti")
        fresh = durable(fresh)
        good = fresh.join(matrix.within_fence(lengths(fresh), matrix.norm_fence(norms, fence), "id"), "id", "left_semi")
        good.select(F.lit(number).alias("round"), "id", "z").write.mode("append").parquet(path)
        held = _accepted(spark, path)
        now = held.count() if held is not None else 0
        quiet, total, number = (quiet + 1 if now == total else 0), now, number + 1
        if quiet >= stall:
            break
    moments = fit.groupBy(F.col(key).alias("channel")).agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("r"))
    moments = moments.select("channel", F.col("r.mu").alias("mu"), F.col("r.sd").alias("sd"))
    if held is None:
        held = original.limit(0).withColumn("round", F.lit(0))
    starts = [sum(k for _, k in dims[:i]) for i in range(len(dims))]
    kind = windows.schema["channel"].dataType
    named = F.array(*[F.struct(F.lit(c).cast(kind).alias("channel"), F.slice("z", s + 1, k).alias("z")) for (c, k), s in zip(dims, starts)])
    rows = held.select(F.struct("round", "id").alias("window"), F.explode(named).alias("s")).select("s.channel", "window", "s.z")
    return matrix.rebuild(rows, lead, moments).select("channel", "window.round", "window.id", "x")
