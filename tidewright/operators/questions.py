"""Questions and answers about series, pair labels, numbered instruction sets, and growing or rewriting samples."""

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.draws import Draws, let
from tidewright.session import durable

two = lambda c: F.format_string("%.2f", c)


def statistic_text(metric, mean, low, low_pos, high, high_pos) -> Column:
    """Context sentence with the mean and both extremes of a series."""
    s = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("In "), F.col(metric), F.lit(", the mean value is "), s(mean), F.lit(", the minimum value is "), s(low), F.lit(" (around point "), s(low_pos),
        F.lit("), and the maximum value is "), s(high), F.lit(" (around point "), s(high_pos), F.lit(");"),
    )


PARTS = ("length", "trend", "season", "frequency", "noise", "local", "statistic")


def _point(c) -> Column:
    return F.floor(c).cast("bigint").cast("string")


def segment_means(y="y", digits=2) -> Column:
    """Means of 32 equal stretches of a series (16 below 64 points, every point below 32); a shorter rest is one more."""
    n = F.size(y)
    step = F.greatest(F.lit(1), F.floor(n / F.when(n >= 64, 32).when(n >= 32, 16).otherwise(n))).cast("int")
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda t, v: t + v) / F.size(s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.round(mean(F.slice(y, i + 1, step)), digits))).otherwise(F.array().cast("array<double>"))


def trend_pieces(y="y") -> Column:
    """Stretches ``(type, start, end)`` of the trend: one, or those between the key points, equal neighbours merged."""
    last = F.size(y) - 1
    heights = F.transform("points", lambda p: p["y"])
    span = F.array_max(heights) - F.array_min(heights)

    def step(k):
        a, b = F.get("points", k), F.get("points", k + 1)
        rise = b["y"] - a["y"]
        kind = F.when(rise > 0.1 * span, "increase").when(rise < -0.1 * span, "decrease").otherwise("keep steady")
        return F.struct(kind.alias("type"), F.floor(a["x"]).cast("int").alias("start"))

    steps = F.transform(F.sequence(F.lit(0), F.size("points") - 2), step)
    heads = let(steps, lambda s: F.filter(s, lambda p, i: (i == 0) | (p["type"] != F.get(s, i - 1)["type"])))
    many = let(heads, lambda h: F.transform(h, lambda p, i: F.struct(p["type"].alias("type"), p["start"].alias("start"), F.coalesce(F.get(h, i + 1)["start"], last).alias("end"))))
    one = F.array(F.struct(F.when(F.col("trend") == "multiple", "keep steady").otherwise(F.col("trend")).alias("type"), F.lit(0).alias("start"), last.alias("end")))
    return F.when((F.col("trend") == "multiple") & (F.size("points") > 1), many).otherwise(one)


def _change_text(c) -> Column:
    return F.concat(F.lit("a "), c["type"], F.lit(" with an amplitude of "), two(c["amplitude"]), F.lit(" between point "), _point(c["position_start"]), F.lit(" and point "), _point(c["position_end"]))


def attribute_text(parts=PARTS) -> Column:
    """Selected attributes of a synthetic series as sentences: length, trend, season, frequency, noise, local, statistic."""
    start, end = F.get("y", F.lit(0)), F.element_at("y", -1)
    pieces = F.transform(trend_pieces(), lambda p: F.concat(p["type"], F.lit(" from point "), _point(p["start"]), F.lit(" to point "), _point(p["end"])))
    periodic = F.col("frequency") != "no periodicity"
    texts = {
        "length": F.concat(F.lit("The length of the time series is "), F.col("seq_len").cast("string"), F.lit(".")),
        "trend": F.concat(F.lit("The overall trend is "), F.col("trend"), F.when(F.col("trend") == "multiple", F.concat(F.lit(" ("), F.array_join(pieces, ", "), F.lit(")"))).otherwise(""), F.lit(", from around "), two(start), F.lit(" to around "), two(end), F.lit(".")),
        "season": F.when(periodic, F.concat(F.lit("There is a "), F.col("season"), F.lit("."))).otherwise("No periodic fluctuations observed."),
        "frequency": F.when(periodic, F.concat(F.lit("Each period is approximately "), F.format_string("%.1f", "period"), F.lit(" points, a "), F.col("frequency"), F.lit("."))),
        "noise": F.concat(F.lit("There is "), F.when(F.col("noise") == "noisy", F.concat(F.lit("a noisy curve with a deviation of about "), two(F.col("noise_std")))).otherwise("almost no noise"), F.lit(".")),
        "local": F.when(F.size("changes") == 0, "No local characteristics are found.").otherwise(
            F.concat(F.lit("In terms of local characteristics, there is "), F.array_join(F.transform("changes", _change_text), "; "), F.lit("."))),
        "statistic": F.concat(
            F.lit("Mean values of stretches of equal length: ["), F.array_join(F.transform(segment_means(), two), ", "), F.lit("]. The highest value is "), two(F.array_max("y")),
            F.lit(" and the lowest is "), two(F.array_min("y")), F.lit(".")),
    }
    unknown = set(parts) - set(texts)
    if unknown:
        raise ValueError(f"unknown parts {sorted(unknown)}")
    return F.concat_ws(" ", *[texts[p] for p in parts])


def ordered_caption() -> Column:
    """A synthetic series told from its first point to its last: trend stretches and changes in the order they come.

    A change that begins inside an earlier one is left out. Length, season, frequency and noise stand before, extremes behind.
    """
    last = F.size("y") - 1
    at = lambda i: two(F.get("y", i.cast("int")))
    event = lambda start, rank, end, text: F.struct(F.floor(start).cast("int").alias("start"), F.lit(rank).alias("rank"), F.floor(end).cast("int").alias("end"), text.alias("text"))
    changes = F.transform("changes", lambda c: event(c["position_start"], 0, c["position_end"], _change_text(c)))
    turns = F.transform(F.filter("_pieces", lambda p: p["start"] > 0), lambda p: event(p["start"], 1, p["start"], F.concat(F.lit("the trend turns to "), p["type"])))
    stretch = lambda a, b: F.concat(F.lit("from point "), a.cast("string"), F.lit(" to point "), b.cast("string"), F.lit(" the trend is "), F.element_at(F.filter("_pieces", lambda p: p["start"] <= a), -1)["type"], F.lit(", with values from "), at(a), F.lit(" to "), at(b))

    def walk(state, e):
        upto = F.when(e["start"] > state["pos"], F.array(stretch(state["pos"], e["start"]))).otherwise(F.array().cast("array<string>"))
        told = F.struct(F.greatest(state["pos"], F.least(e["end"], last)).alias("pos"), F.concat(state["parts"], upto, F.array(e["text"])).alias("parts"))
        return F.when(e["start"] >= state["pos"], told).otherwise(state)

    begin = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("parts"))
    close = lambda s: F.when(s["pos"] < last, F.array_append(s["parts"], F.concat(F.lit("finally, "), stretch(s["pos"], last)))).otherwise(s["parts"])
    walked = F.aggregate(F.array_sort(F.concat(changes, turns)), begin, walk, close)
    body = F.concat(F.lit("At the beginning, "), F.array_join(walked, "; "), F.lit("."))
    return let(trend_pieces(), lambda pieces: pieces).alias("_pieces"), F.concat_ws(" ", attribute_text(("length", "season", "frequency", "noise")), body, attribute_text(("statistic",)))


def captions(series: DataFrame, id="series_id") -> DataFrame:
    """``(id, caption)`` of synthetic series."""
    pieces, caption = ordered_caption()
    return series.withColumn("_pieces", pieces).select(id, caption.alias("caption"))


def as_json() -> Column:
    """The attributes of a synthetic series as one JSON object."""
    periodic = F.col("frequency") != "no periodicity"
    local = F.transform("changes", lambda c: F.struct(c["type"].alias("type"), F.floor(c["position_start"]).cast("bigint").alias("start"), F.floor(c["position_end"]).cast("bigint").alias("end"), F.round(c["amplitude"], 2).alias("amplitude")))
    return F.to_json(F.struct(
        F.struct(F.col("season").alias("type")).alias("periodicity"),
        F.struct(F.col("trend").alias("type"), F.round(F.get("y", F.lit(0)), 2).alias("from"), F.round(F.element_at("y", -1), 2).alias("to")).alias("trend"),
        local.alias("local"), F.struct(F.col("frequency").alias("type"), F.when(periodic, F.round("period", 1)).alias("period")).alias("frequency"), F.struct(F.col("noise").alias("type")).alias("noise")))


SHAPE = ("length", "trend", "season", "frequency", "noise", "local")
ASK_SHAPE = "Please describe the periodicity, trend, local changes, frequency and noise of this time series."
ASK_VALUES = "Please describe the periodicity, trend, local changes, frequency and noise of this time series, with mean values of equal stretches and both extremes."
ASK_JSON = "Please give the characteristics of this time series as JSON with the fields periodicity, trend, local, frequency and noise."


def series_questions(series: DataFrame, seed=0, id="series_id", clear=50, explain=False) -> DataFrame:
    """``(id, question_no, kind, question, answer, fields)`` per synthetic series: its shape, its shape with values, each change, up
    to three points without one, and a JSON object. ``fields`` names the attributes a question needs.

    With ``explain`` an answer about a change ends in a numbered slot and ``prompt`` asks a model for its likely cause
    (``series`` then names its ``metric``).
    """
    d = Draws(seed, id)
    ask = F.lit("Is there a local fluctuation that starts around point ")
    none = F.lit(None).cast("string")

    def entry(kind, q, a, fields, prompt=none):
        return F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"), F.array(*[F.lit(f) for f in fields]).alias("fields"), prompt.alias("prompt"))

    head = F.array(
        entry("shape", F.lit(ASK_SHAPE), attribute_text(SHAPE), ["trend", "seasonal", "noise", "local"]),
        entry("values", F.lit(ASK_VALUES), attribute_text(PARTS), ["trend", "seasonal", "noise", "local", "statistic"]))
    slot = lambda c: F.concat(F.lit(" <cause "), c["no"].cast("string"), F.lit(">")) if explain else F.lit("")
    why = lambda c: F.concat(F.lit("The metric "), F.col("metric"), F.lit(" shows "), _change_text(c), F.lit(". Name a likely cause in one sentence.")) if explain else none
    yes = F.transform("changes", lambda c: entry(
        "change", F.concat(ask, (c["position_start"] + d.whole(-5, 5, "near", c["no"])).cast("bigint").cast("string"), F.lit("?")),
        F.concat(F.lit("Yes, there is "), _change_text(c), F.lit("."), slot(c)), ["local"], why(c)))
    spots = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: d.whole(F.lit(0), F.col("seq_len") - 1, "spot", k))
    free = F.filter(spots, lambda p: F.forall("changes", lambda c: F.abs(p - c["position_start"]) >= clear))
    no = F.transform(free, lambda p: entry("no change", F.concat(ask, p.cast("string"), F.lit("?")), F.concat(F.lit("I did not find any fluctuation starting around point "), p.cast("string"), F.lit(".")), ["local"]))
    tail = F.array(entry("json", F.lit(ASK_JSON), as_json(), ["trend", "seasonal", "noise", "local"]))
    rows = series.select(id, F.posexplode(F.concat(head, yes, no, tail)).alias("question_no", "_q"))
    out = rows.select(id, "question_no", "_q.kind", "_q.question", "_q.answer", "_q.fields", "_q.prompt")
    return out if explain else out.drop("prompt")


# The field that each describable attribute belongs to.
FIELD_OF = {"trend": "trend", "season": "seasonal", "frequency": "seasonal", "noise": "noise", "local": "local"}
FIELD_PARTS = {"trend": ("trend",), "seasonal": ("season", "frequency"), "noise": ("noise",), "local": ("local",)}


def system_questions(series: DataFrame, seed=0, within=15) -> DataFrame:
    """``(system, question_no, kind, question, answer, fields)`` about the series of one system.

    ``series(system, series_no, metric, ...)`` are synthetic series, ``series_no`` from 0. Kinds: one drawn series, one drawn attribute
    of all, groups with the same trend, groups whose changes come at the same places. ``fields`` maps a field to the series
    numbers it concerns; ``correlation`` there numbers the group answers of the system.
    """
    of = Draws(seed, "system")
    texts = {k: attribute_text((k,)) for k in FIELD_OF}
    told = durable(series.select("system", "series_no", "metric", "trend", F.transform("changes", lambda c: c["position_start"]).alias("positions"), attribute_text(SHAPE).alias("whole"), F.create_map(*[x for k, c in texts.items() for x in (F.lit(k), c)]).alias("by_part")))
    sizes = told.groupBy("system").agg(F.count("*").alias("_size"))
    sized = told.join(sizes, "system")
    number = (F.col("series_no") + 1).cast("string")
    index = lambda names, ids: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[ids for _ in names]))
    alone = F.array(F.col("series_no").cast("int"))
    one = sized.where(F.col("series_no") == of.whole(F.lit(0), F.col("_size") - 1, "one")).select(
        "system", F.lit("one").alias("kind"), F.lit(0).alias("_o"), F.concat(F.lit("Please describe time series "), number, F.lit(" ("), F.col("metric"), F.lit(").")).alias("question"),
        F.col("whole").alias("answer"), index(("trend", "seasonal", "noise", "local"), alone).alias("fields"))
    part = F.array(*[F.lit(k) for k in FIELD_OF])[of.whole(0, len(FIELD_OF) - 1, "part").cast("int")]
    line = F.concat(F.lit("Time series "), number, F.lit(" ("), F.col("metric"), F.lit("): "), F.coalesce(F.col("by_part")[F.col("_part")], F.lit("none.")))
    all_lines = told.withColumn("_part", part).groupBy("system", "_part").agg(F.array_sort(F.collect_list(F.struct(F.col("series_no").cast("int").alias("no"), line.alias("line")))).alias("l"))
    names = F.create_map(*[F.lit(x) for kv in FIELD_OF.items() for x in kv])
    every = all_lines.select(
        "system", F.lit("all").alias("kind"), F.lit(1).alias("_o"), F.concat(F.lit("Please describe the "), F.col("_part"), F.lit(" of all time series.")).alias("question"),
        F.array_join(F.col("l.line"), "\n").alias("answer"), F.map_from_arrays(F.array(names[F.col("_part")]), F.array(F.col("l.no"))).alias("fields"))
    same = told.where("trend <> 'multiple'").select("system", "series_no", "metric", F.concat(F.lit("trend "), "trend").alias("_g"), F.concat(F.lit("the trend of each is "), "trend").alias("_why"), F.lit("trend").alias("_f"))
    groups = similar_groups(told.select("system", "series_no", "positions"), within, "series_no")
    lead = told.select("system", F.col("series_no").alias("representative"), F.array_join(F.transform("positions", _point), ", ").alias("_at"))
    near = groups.join(told.select("system", "series_no", "metric"), ["system", "series_no"]).join(lead, ["system", "representative"]).select(
        "system", "series_no", "metric", F.concat(F.lit("changes "), F.col("representative").cast("string")).alias("_g"), F.concat(F.lit("all change near points "), "_at").alias("_why"), F.lit("local").alias("_f"))
    packed = same.unionByName(near).groupBy("system", "_f", "_g", "_why").agg(F.array_sort(F.collect_list(F.struct(F.col("series_no").cast("int").alias("no"), "metric"))).alias("m")).where(F.size("m") > 1)
    order = Window.partitionBy("system").orderBy(F.desc("_f"), F.col("m")[0]["no"])  # a system is a few series
    packed = packed.withColumn("_c", (F.row_number().over(order) - 1).cast("int"))
    asked = F.get("m", of.whole(F.lit(0), F.size("m") - 1, "asked", F.col("_c")).cast("int"))["metric"]
    about = F.when(F.col("_f") == "trend", "a similar trend to").otherwise("changes at similar places to")
    grouped = packed.select(
        "system", F.concat(F.lit("same "), "_f").alias("kind"), (F.col("_c") + 2).alias("_o"), F.concat(F.lit("Which time series have "), about, F.lit(" "), asked, F.lit("?")).alias("question"),
        F.concat(F.array_join(F.col("m.metric"), ", "), F.lit(": "), F.col("_why"), F.lit(".")).alias("answer"),
        F.map_from_arrays(F.array(F.col("_f"), F.lit("correlation")), F.array(F.col("m.no"), F.array(F.col("_c")))).alias("fields"))
    out = one.unionByName(every).unionByName(grouped)
    line_no = F.row_number().over(Window.partitionBy("system").orderBy("_o"))
    return out.withColumn("question_no", (line_no - 1).cast("int")).drop("_o").select("system", "question_no", "kind", "question", "answer", "fields")


def field_contexts(required: DataFrame, series: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``(system, field, context)``: the attributes that a question needs, as one text per field.

    ``required(system, field, numbers)`` lists series numbers per field (trend, seasonal, noise, local, statistic) or, for
    ``correlation``, numbers of ``groups(system, group_no, answer)``. ``series`` are as in ``system_questions``.
    """
    s = F.col("statistics")
    numbers = [F.lit("the mean is "), two(s["mean"]), F.lit(", the lowest value "), two(s["min"]), F.lit(" (around point "), s["min_pos"].cast("string"), F.lit("), the highest "), two(s["max"]), F.lit(" (around point "), s["max_pos"].cast("string"), F.lit(").")]
    by_field = {**{f: attribute_text(parts) for f, parts in FIELD_PARTS.items()}, "statistic": F.concat(*numbers)}
    told = series.select("system", F.col("series_no").cast("int").alias("no"), "metric", F.explode(F.create_map(*[x for f, c in by_field.items() for x in (F.lit(f), c)])).alias("field", "text"))
    wanted = required.select("system", "field", F.explode("numbers").alias("no"))
    lines = wanted.join(told, ["system", "field", "no"]).select("system", "field", "no", F.concat(F.lit("In "), "metric", F.lit(": "), "text").alias("line"))
    if groups is not None:
        pool = groups.select("system", F.lit("correlation").alias("field"), F.col("group_no").cast("int").alias("no"), F.col("answer").alias("line"))
        lines = lines.unionByName(wanted.join(pool, ["system", "field", "no"]).select("system", "field", "no", "line"))
    packed = lines.groupBy("system", "field").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    return packed.select("system", "field", F.concat(F.lit("About the "), "field", F.lit(" of some time series:\n"), F.array_join(F.col("l.line"), "\n")).alias("context"))


def pair_questions(pairs: DataFrame, series: DataFrame, positions: DataFrame) -> DataFrame:
    """``(system, metric_id, other, label, question, answer, prompt)``: do two metrics move together around the asked point?

    ``pairs`` come from ``labelled_pairs``, ``series(system, metric_id, metric, cluster, ...)`` are synthetic, ``positions(system, group_no,
    point)`` say where a group changes; the asked group is 0. An answer ends in a slot for the reason that ``prompt`` asks a
    model for; metrics of one cluster get that as a hint.
    """
    told = durable(series.select("system", "metric_id", "metric", "cluster", "group_no", attribute_text(SHAPE).alias("text")))
    a = told.select("system", "metric_id", *[F.col(c).alias(f"a_{c}") for c in ("metric", "cluster", "group_no", "text")])
    b = told.select("system", F.col("metric_id").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("metric", "cluster", "group_no", "text")])
    point = positions.where("group_no = 0").select("system", F.col("point").cast("string").alias("_at"))
    theirs = positions.select("system", F.col("group_no").alias("a_group_no"), F.col("point").cast("string").alias("_own"))
    rows = pairs.join(a, ["system", "metric_id"]).join(b, ["system", "other"]).join(point, "system").join(theirs, ["system", "a_group_no"], "left")
    both = F.concat(F.col("a_metric"), F.lit(" and "), F.col("b_metric"))
    question = F.concat(F.lit("Please describe "), both, F.lit(" and say whether their fluctuations around point "), F.col("_at"), F.lit(" may be related."))
    verdict = F.when(F.col("label") == "positive", F.concat(F.lit("Both change suddenly around point "), F.col("_at"), F.lit(", so they may be related.")))
    verdict = verdict.when(F.col("label") == "elsewhere", F.concat(F.lit("No. Both change around point "), F.col("_own"), F.lit(", but not around point "), F.col("_at"), F.lit(".")))
    verdict = verdict.otherwise(F.concat(F.lit("They don't seem to be related around point "), F.col("_at"), F.lit(".")))
    told_by = F.concat("a_metric", F.lit(": "), "a_text", F.lit(" "), "b_metric", F.lit(": "), "b_text", F.lit(" "), verdict, F.lit(" <reason>"))
    in_group = lambda c: F.coalesce(F.col(c) == 0, F.lit(False))
    seen = F.when(F.col("label") == "positive", F.concat(both, F.lit(" fluctuate together. Say why in one sentence.")))
    seen = seen.when(F.col("label") == "elsewhere", F.concat(both, F.lit(" don't fluctuate now, though they do at another time. Say why in one sentence.")))
    seen = seen.when(in_group("a_group_no"), F.concat("a_metric", F.lit(" fluctuates, "), "b_metric", F.lit(" doesn't. Say why in one sentence.")))
    seen = seen.when(in_group("b_group_no"), F.concat("b_metric", F.lit(" fluctuates, "), "a_metric", F.lit(" doesn't. Say why in one sentence.")))
    seen = seen.otherwise(F.concat(F.lit("Some metrics fluctuate, but neither of "), both, F.lit(". Say why in one sentence.")))
    hint = F.when((F.col("a_cluster") == F.col("b_cluster")) & F.col("label").isin("positive", "elsewhere"), F.concat(F.lit(" Hint: both are about "), "a_cluster", F.lit("."))).otherwise("")
    return rows.select("system", "metric_id", "other", "label", question.alias("question"), told_by.alias("answer"), F.concat(seen, hint).alias("prompt"))


def cluster_questions(series: DataFrame, positions: DataFrame) -> DataFrame:
    """``(system, metric_id, question, answer, prompt)``: which other metrics move with this one around the asked point?

    Inputs as in ``pair_questions``. Members of group 0 name each other with their kinds of change; the others name none.
    """
    told = durable(series.select("system", "metric_id", "metric", "group_no", F.get("changes", F.lit(0))["type"].alias("change")))
    group = told.where("group_no = 0").groupBy("system").agg(F.array_sort(F.collect_list(F.struct("metric_id", "metric", "change"))).alias("g"))  # a cluster of one system's vocabulary
    point = positions.where("group_no = 0").select("system", F.col("point").cast("string").alias("_at"))
    rows = told.join(point, "system").join(group, "system", "left")
    others = F.filter("g", lambda m: m["metric_id"] != F.col("metric_id"))
    line = lambda m: F.when(m["change"].eqNullSafe(F.col("change")), F.concat(m["metric"], F.lit(" shows "), m["change"], F.lit(" as well"))).otherwise(F.concat(m["metric"], F.lit(" shows "), F.coalesce(m["change"], F.lit("a change"))))
    inside = F.coalesce(F.col("group_no") == 0, F.lit(False)) & (F.size(others) > 0)
    found = F.concat(F.lit("These may be related to "), "metric", F.lit(" around point "), "_at", F.lit(": "), F.array_join(F.transform(others, line), "; "), F.lit(". <reason>"))
    none = F.concat(F.lit("I did not find other metrics related to "), "metric", F.lit(" around point "), "_at", F.lit("."))
    prompt = F.when(inside, F.concat(F.array_join(F.transform("g", lambda m: m["metric"]), ", "), F.lit(" fluctuate together. Say in one sentence what they share.")))
    question = F.concat(F.lit("Which other metrics may be related to "), "metric", F.lit(" by their fluctuations around point "), "_at", F.lit(", and why?"))
    return rows.select("system", "metric_id", question.alias("question"), F.when(inside, found).otherwise(none).alias("answer"), prompt.alias("prompt"))


SMALL_GROUP = 64  # metrics that are walked in one row


def similar_groups(members: DataFrame, within=15, id="metric_id") -> DataFrame:
    """``(system, representative, metric_id)``: metrics of one system with equally many changes, near a representative.

    ``members(system, metric_id, positions)``; metrics without changes are left out. In order of id, a metric whose changes
    all lie within ``within`` steps of an earlier representative's joins the first such one, else it becomes a representative.
    Up to SMALL_GROUP metrics of a system with equally many changes are walked in one row. Others meet by cells of their first,
    middle and last change. A round settles the lowest open metric of every cell, so a group of any size is removed by one metric
    and no list of pairs is formed.
    """
    p, width = F.col("positions"), float(within + 1)
    place = {"_x": p[0], "_y": p[F.floor(F.size(p) / 2).cast("int")], "_z": F.element_at(p, -1)}
    rows = members.where(F.size("positions") > 0).select("system", F.col(id).alias("id"), "positions", F.size("positions").alias("_n"), *[F.floor(c / width).cast("bigint").alias(n) for n, c in place.items()])
    group = ["system", "_n"]
    rows = durable(rows.withColumn("_held", F.count("*").over(Window.partitionBy(*group))))
    near_to = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= within, F.lit(True))), lambda ok: ok)

    def walked(done, m):
        """``done`` and the metric ``m`` under the first representative near it, or under itself."""
        led = F.filter(done, lambda d: (d["id"] == d["lead"]) & near_to(d["p"], m["positions"]))
        lead = F.coalesce(F.get(led, F.lit(0))["lead"], m["id"])
        return F.concat(done, F.array(F.struct(lead.alias("lead"), m["id"].alias("id"), m["positions"].alias("p"))))

    lone = rows.where(F.col("_held") == 1).select("system", F.col("id").alias("representative"), F.col("id").alias(id))
    packed = rows.where(F.col("_held").between(2, SMALL_GROUP)).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("id", "positions"))).alias("m"))
    first = F.struct(F.get("m", F.lit(0))["id"].alias("lead"), F.get("m", F.lit(0))["id"].alias("id"), F.get("m", F.lit(0))["positions"].alias("p"))
    packed = packed.select("system", F.explode(F.aggregate(F.slice("m", F.lit(2), F.size("m")), F.array(first), walked)).alias("d"))
    settled = lone.unionByName(packed.select("system", F.col("d.lead").alias("representative"), F.col("d.id").alias(id)))
    rows = durable(rows.where(F.col("_held") > SMALL_GROUP).drop("_held"))
    if rows.isEmpty():
        return settled.groupBy("system", id).agg(F.min("representative").alias("representative")).select("system", "representative", id)
    cell = ["system", "_n", "_x", "_y", "_z"]
    steps = F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip(place, step)]) for step in itertools.product((-1, 0, 1), repeat=3)])
    near = near_to("positions", "_p")

    def around(some):
        """``some`` in its own and all neighbouring cells, under names of their own."""
        spread = some.withColumn("_s", F.explode(steps)).withColumns({n: F.col(n) + F.col(f"_s.{n}") for n in place})
        return spread.select(*cell, F.col("id").alias("_lead"), F.col("positions").alias("_p"))

    opened, kept = rows, None
    while True:
        least = opened.groupBy(*cell).agg(F.min("id").alias("id"))
        leaders = opened.join(least, [*cell, "id"], "left_semi")
        meets = opened.join(around(leaders), cell).where((F.col("id") != F.col("_lead")) & near)
        waiting = meets.where(F.col("id") < F.col("_lead")).select("system", F.col("_lead").alias("id")).distinct()
        sure = durable(leaders.join(waiting, ["system", "id"], "left_anti"))
        gone = opened.join(around(sure), cell).where((F.col("id") >= F.col("_lead")) & near).select("system", "id").distinct()
        opened = durable(opened.join(gone, ["system", "id"], "left_anti"))
        kept = sure if kept is None else kept.unionByName(sure)
        if opened.isEmpty():
            break
    joined = rows.join(around(kept), cell).where((F.col("_lead") <= F.col("id")) & near)
    settled = settled.unionByName(joined.select("system", F.col("_lead").alias("representative"), F.col("id").alias(id)))
    return settled.groupBy("system", id).agg(F.min("representative").alias("representative")).select("system", "representative", id)


def pair_label(group, other_group, asked=0) -> Column:
    """``positive`` in the asked group, ``elsewhere`` in the same other group, else ``negative``."""
    same = F.col(group) == F.col(other_group)
    return F.when(same & (F.col(group) == asked), "positive").when(same, "elsewhere").otherwise("negative")


def labelled_pairs(members: DataFrame, seed=0, keep=0.2) -> DataFrame:
    """Ordered metric pairs of a system with their label: all positive ones and a drawn share of the rest.

    ``members(system, metric_id, group_no)``; a system is a bounded metric vocabulary. The draw is made per pair of
    places before any pair is formed.
    """
    d = Draws(seed, "metric_id")
    packed = members.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("metric_id", "group_no"))).alias("_m"))
    wanted = F.filter("_m", lambda o: (o["metric_id"] != F.col("metric_id")) & (
        (F.coalesce(o["group_no"] == 0, F.lit(False)) & F.coalesce(F.col("group_no") == 0, F.lit(False))) | (d.uniform("pair", o["metric_id"]) < keep)))
    rows = members.join(packed, "system").select("system", "metric_id", "group_no", F.explode(wanted).alias("_o"))
    out = rows.select("system", "metric_id", "group_no", F.col("_o.metric_id").alias("other"), F.col("_o.group_no").alias("other_group"))
    return out.withColumn("label", pair_label("group_no", "other_group")).drop("group_no", "other_group")


def numbered_set(samples: DataFrame, id: str, questions: str, count=(3, 4), seed=0) -> DataFrame:
    """Three to four drawn questions per sample as one numbered instruction and one numbered answer.

    ``questions`` is ``array<struct<question, answer>>``.
    """
    d = Draws(seed, id)
    placed = F.transform(questions, lambda q, i: F.struct(d.uniform("order", i).alias("o"), i.alias("i"), q.alias("q")))
    take = d.whole(count[0], count[1], "count").cast("int")
    rows = samples.withColumn("_q", F.slice(F.array_sort(placed), F.lit(1), take))
    line = lambda field: F.array_join(F.transform("_q", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["q"][field])), "\n")
    return rows.select(id, line("question").alias("instruction"), line("answer").alias("answer"), F.size("_q").alias("n_questions"))


def checked(rows: DataFrame, verdict: str, fields) -> DataFrame:
    """Add ``reason``: a missing field, or a check that does not say pass or says fail; NULL when accepted."""
    said = F.lower(F.col(verdict))
    missing = F.lit(False)
    for name in fields:
        missing = missing | F.col(name).isNull() | (F.col(name) == "")
    ok = F.coalesce(F.contains(said, F.lit("pass")) & ~F.contains(said, F.lit("fail")), F.lit(False))
    return rows.withColumn("reason", F.when(missing, "missing field").when(~ok, "not passed"))


# The attribute fields a sample can grow by, and the weights of the rewriting kinds.
FIELDS = ["trend", "seasonal", "noise", "local", "statistic", "correlation"]
REWRITES = {"shorter": 0.1, "longer": 0.1, "rephrase": 0.2, "reason": 0.5, "format": 0.1}


def _with_path(samples: DataFrame) -> DataFrame:
    return samples if "path" in samples.columns else samples.withColumn("path", F.array().cast("array<int>"))


def evolve(samples: DataFrame, answer, rounds=2, children=1, seed=0) -> DataFrame:
    """Grow samples by one unused field per round; only children with a ``valid`` verdict live on.

    ``samples(sample_id, text, fields, history)``; ``answer(df) -> df`` adds ``reply`` and ``verdict``. A grown sample is named by its
    ``sample_id`` and ``path``, the child numbers that led to it (empty for a given sample); draws depend on both. The
    last two texts are kept as history. Each round is written out.
    """
    columns = ["sample_id", "path", "text", "fields", "history"]
    live = _with_path(samples).select(*columns)
    out = live
    for number in range(rounds):
        d = Draws(seed + number, "_who")
        spread = live.withColumn("_who", F.xxhash64("sample_id", "path")).withColumn("child", F.explode(F.sequence(F.lit(1), F.lit(children))))
        unused = F.array_except(F.array(*[F.lit(f) for f in FIELDS]), F.col("fields"))
        spread = spread.withColumn("_u", unused).where(F.size("_u") > 0)
        field = F.get("_u", F.floor(d.uniform("field", F.col("child")) * F.size("_u")).cast("int"))
        asked = answer(spread.withColumn("field", field).drop("_u", "_who"))
        good = asked.where(F.lower(F.trim("verdict")) == "valid")
        history = F.slice(F.concat(F.array("text"), "history"), F.lit(1), F.lit(2))
        grown = [F.array_append("path", F.col("child")).alias("path"), F.col("reply").alias("text"), F.array_append("fields", F.col("field")).alias("fields"), history.alias("history")]
        live = durable(good.select("sample_id", *grown))
        out = out.unionByName(live)
    return out


def rewrite(samples: DataFrame, ask, judge, rounds=1, children=1, seed=0) -> DataFrame:
    """Accepted rewritings: ``(sample_id, path, kind, question, answer, history)``.

    ``samples(sample_id, question, answer)``. Every sample is rewritten ``children`` times a round, in a way drawn by weight;
    ``ask(df)`` adds ``new_question`` and ``new_answer`` (NULL when the reply can't be read), ``judge(df)`` returns a column with the
    verdict on the new pair against the old. It is accepted if that says valid and not invalid, and is rewritten again in the
    next round; ``history`` holds the last two questions before it. Each round is written out.
    """
    live = _with_path(samples).select("sample_id", "path", "question", "answer", F.array().cast("array<string>").alias("history"))
    out = None
    for number in range(rounds):
        spread = live.withColumn("_who", F.xxhash64("sample_id", "path")).withColumn("child", F.explode(F.sequence(F.lit(1), F.lit(children))))
        drawn = spread.withColumn("kind", Draws(seed + number, "_who").weighted(REWRITES, "rewrite", F.col("child"))).drop("_who")
        asked = ask(drawn).where(F.col("new_question").isNotNull() & F.col("new_answer").isNotNull())
        said = F.lower(judge(asked))
        good = asked.where(F.coalesce(F.contains(said, F.lit("valid")) & ~F.contains(said, F.lit("invalid")), F.lit(False)))
        history = F.slice(F.concat(F.array("question"), "history"), F.lit(1), F.lit(2))
        made = good.select("sample_id", F.array_append("path", F.col("child")).alias("path"), "kind", F.col("new_question").alias("question"), F.col("new_answer").alias("answer"), history.alias("history"))
        made = durable(made)
        out = made if out is None else out.unionByName(made)
        live = made.drop("kind")
    return out


def rewrite_kind(id: str, seed=0) -> Column:
    return Draws(seed, id).weighted(REWRITES, "rewrite")


def until_enough(make_round, path: str, spark, wanted: int, stall=3) -> tuple[int, str]:
    """Append ``make_round(number)`` to a Parquet table until it holds ``wanted`` rows or nothing new comes.

    Rows already in the table count, so a restarted job resumes. Returns the rows held and why it stopped: ``enough`` or
    ``stalled`` after ``stall`` rounds without a new row.
    """
    def stored():
        try:
            return spark.read.parquet(path).count()
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return 0
            raise

    total, quiet = stored(), 0
    number = 0
    while total < wanted and quiet < stall:
        make_round(number).write.mode("append").parquet(path)
        now = stored()
        quiet, total, number = (quiet + 1 if now == total else 0), now, number + 1
    return total, "enough" if total >= wanted else "stalled"
