"""Attribute-driven synthetic series: one row per series, every component an array in that row.

Attribute rows are dealt over the cluster once; attributes, changes, components and statistics of a series are expressions
over its id, so the job scales with the number of series and gives the same rows in any partitioning. Steps that build on many earlier
columns are written out in between, which keeps each plan small. The length of one series is a parameter of at most a
few thousand points.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.draws import Draws, let
from tidewright.session import durable, spread_out

# Attribute weights.
SEASONAL = {
    "no periodic fluctuation": 0.7, "sin periodic fluctuation": 0.25, "square periodic fluctuation": 0.02,
    "triangle periodic fluctuation": 0.03,
}
TREND = {"decrease": 0.3, "increase": 0.3, "keep steady": 0.3, "multiple": 0.1}
FREQUENCY = {"high frequency": 0.5, "low frequency": 0.5}
NOISE = {"noisy": 0.2, "almost no noise": 0.8}
CHANGES = {
    "shake": 2, "upward spike": 12, "downward spike": 10, "continuous upward spike": 3, "continuous downward spike": 3,
    "upward convex": 2, "downward convex": 2, "sudden increase": 10, "sudden decrease": 10,
    "rapid rise followed by slow decline": 2, "slow rise followed by rapid decline": 2,
    "rapid decline followed by slow rise": 2, "slow decline followed by rapid rise": 2, "decrease after upward spike": 1,
    "increase after downward spike": 1, "increase after upward spike": 1, "decrease after downward spike": 1,
    "wide upward spike": 2, "wide downward spike": 2,
}
# Changes that a short series with several trends cannot hold, and those that a tiny one cannot.
TOO_WIDE_FOR_SHORT = [
    "upward convex", "downward convex", "rapid rise followed by slow decline", "slow rise followed by rapid decline",
    "rapid decline followed by slow rise", "slow decline followed by rapid rise", "decrease after upward spike", "increase after downward spike",
    "increase after upward spike", "decrease after downward spike", "wide upward spike", "wide downward spike",
]
TOO_WIDE_FOR_TINY = ["shake", "sudden increase", "sudden decrease"]
AMPLITUDE_EXPONENTS = {-2: 0.1, -1: 0.2, 0: 0.2, 1: 0.3, 2: 0.1, 3: 0.04, 4: 0.03, 5: 0.02, 6: 0.008, 7: 0.002}
SPIKE_SIDE = {1: 0.96, 2: 0.03, 3: 0.01}
SPIKE_TOP = {0: 0.99, 1: 0.005, 2: 0.005}


def random_attributes(series: DataFrame, seed=0, id="series_id", max_changes=3) -> DataFrame:
    """Add season, frequency, trend, noise and change types by weight; short series lose what they cannot show.

    ``series(series_id, seq_len)``. ``change_types`` holds 0 to ``max_changes`` names.
    """
    d, n = Draws(seed, id), F.col("seq_len")
    less = lambda drop: {k: v for k, v in CHANGES.items() if k not in drop}
    kinds = []
    for j in range(max_changes):
        tiny = d.weighted(less(TOO_WIDE_FOR_TINY + TOO_WIDE_FOR_SHORT), "change", j)
        tiny_plain = d.weighted(less(TOO_WIDE_FOR_TINY), "change", j)
        short = d.weighted(less(TOO_WIDE_FOR_SHORT), "change", j)
        many = (n <= 64) & (F.col("trend") == "multiple")
        kinds.append(F.when(many & (n <= 8), tiny).when(n <= 8, tiny_plain).when(many, short).otherwise(d.weighted(CHANGES, "change", j)))
    return (
        series.withColumn("season", F.when(n >= 24, d.weighted(SEASONAL, "season")).otherwise("no periodic fluctuation"))
        .withColumn("trend", d.weighted(TREND, "trend"))
        .withColumn(
            "frequency",
            F.when(F.startswith("season", F.lit("no ")), "no periodicity").when(n <= 64, "low frequency").otherwise(d.weighted(FREQUENCY, "frequency")),
        )
        .withColumn("noise", F.when(n <= 32, "almost no noise").otherwise(d.weighted(NOISE, "noise")))
        .withColumn("change_types", F.slice(F.array(*kinds), F.lit(1), d.whole(0, max_changes, "n_changes").cast("int")))
    )


def _drawn(weights: dict, u: Column, allowed: Column) -> Column:
    """One of the names of ``weights`` that ``allowed`` lists, drawn by weight; NULL if it lists none of them."""
    listed = ", ".join(f"named_struct('n', '{n}', 'w', {float(w)!r}D)" for n, w in weights.items())
    entries = F.filter(F.expr(f"array({listed})"), lambda e: F.array_contains(allowed, e["n"]))

    def pick(some):
        total = F.aggregate(some, F.lit(0.0), lambda t, e: t + e["w"])
        start = F.struct((u * total).alias("left"), F.lit(None).cast("string").alias("n"))
        step = lambda s, e: F.when(s["left"] < 0, s).otherwise(F.struct((s["left"] - e["w"]).alias("left"), e["n"].alias("n")))
        return F.aggregate(some, start, step, lambda s: s["n"])

    return let(entries, pick)


# The attributes that a metric may limit to a list of types.
TYPE_LISTS = {"season": SEASONAL, "trend": TREND, "noise": NOISE}


def controlled_attributes(series: DataFrame, metrics: DataFrame, seed=0, id="series_id") -> DataFrame:
    """Random attributes with types and sizes from a metric's lists and ranges.

    ``metrics(metric, amplitude_min, amplitude_max, bias_min, bias_max, period_min, period_max)``; a given period, six points at
    least, makes a high frequency if it is below an eighth of the length. Optional columns: ``season_types``, ``trend_types``,
    ``noise_types`` and ``change_types_allowed`` list the types to draw from by weight; ``trend_start_*`` and ``trend_rise_*`` bound the
    level and rise of a trend, ``change_size_*`` the amplitude of every change.
    """
    d = Draws(seed + 1, id)
    base = random_attributes(series, seed, id).join(metrics, "metric")
    for name, weights in TYPE_LISTS.items():
        if f"{name}_types" in metrics.columns:
            base = base.withColumn(name, F.coalesce(_drawn(weights, d.uniform(f"{name} type"), F.col(f"{name}_types")), F.col(name)))
    if "change_types_allowed" in metrics.columns:
        base = base.withColumn("change_types", F.transform("change_types", lambda c, j: F.coalesce(_drawn(CHANGES, d.uniform("change type", j), F.col("change_types_allowed")), c)))
    span = lambda n: d.between(F.col(f"{n}_min"), F.col(f"{n}_max"), n)
    periodic = ~F.startswith("season", F.lit("no "))
    out = base.withColumns({"overall_amplitude": F.round(span("amplitude"), 2), "overall_bias": F.round(span("bias"), 2)})
    out = out.withColumn("period", F.when(periodic, F.round(F.greatest(span("period"), F.lit(6.0)), 1)))
    kind = F.when(F.col("period") < F.floor(F.col("seq_len") / 8), "high frequency").otherwise("low frequency")
    out = out.withColumn("frequency", F.when(periodic, kind).otherwise("no periodicity"))
    ranges = ["amplitude", "bias", "period"]
    for name in ("trend_start", "trend_rise"):
        if f"{name}_min" in metrics.columns:
            out, ranges = out.withColumn(name, F.round(span(name), 2)), [*ranges, name]
    if "change_size_min" in metrics.columns:
        size = lambda c, j: F.round(d.between(F.col("change_size_min"), F.col("change_size_max"), "change size", j), 2)
        out, ranges = out.withColumn("change_sizes", F.transform("change_types", size)), [*ranges, "change_size"]
    lists = [c for c in [*[f"{n}_types" for n in TYPE_LISTS], "change_types_allowed"] if c in metrics.columns]
    return out.drop(*lists, *[f"{n}_{s}" for n in ranges for s in ("min", "max")])


def _with_scale(df: DataFrame, d: Draws) -> DataFrame:
    """Overall amplitude, bias and period, drawn where the row does not give them."""
    e = d.weighted({k: w for k, w in AMPLITUDE_EXPONENTS.items()}, "exponent").cast("double")
    ten = lambda x: F.pow(F.lit(10.0), x)
    given = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    n = F.col("seq_len")
    part = lambda k: F.floor(n / k)
    high = d.between(F.greatest(part(16), F.lit(6)), part(8), "period")
    low = d.between(F.greatest(part(8), F.lit(6)), part(3), "period")
    drawn = F.when(F.col("frequency") == "high frequency", high).when(F.col("frequency") == "low frequency", low)
    return df.withColumns(
        {
            "overall_amplitude": F.coalesce(given("overall_amplitude"), F.round(d.between(ten(e - 1), ten(e + 1), "amplitude"), 2)),
            "overall_bias": F.coalesce(given("overall_bias"), F.round(d.between(-ten(e + 1), ten(e + 1), "bias"), 2)),
            "period": F.when(F.col("frequency") == "no periodicity", 0.0).otherwise(F.coalesce(given("period"), F.round(drawn, 1))),
        }
    )


def split_points(d: Draws, name: str, n: Column, segments: Column) -> Column:
    """Borders ``[0, …, n]`` of one to three segments, none shorter than half an equal share."""
    least = n / segments / 2.0
    first = F.floor(d.between(least, n - (segments - 1) * least, name, 1))
    second = F.floor(d.between(first + least, n - least, name, 2))
    return (
        F.when(segments == 1, F.array(F.lit(0), n))
        .when(segments == 2, F.array(F.lit(0), first, n))
        .otherwise(F.array(F.lit(0), first, second, n))
        .cast("array<bigint>")
    )


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _segment_value(borders: Column, values: Column, i: Column) -> Column:
    """Value of the segment a step lies in."""
    at = F.size(F.filter(borders, lambda b: b <= i)) - 1
    return F.get(values, F.least(at, F.size(values) - 1))


def with_season(df: DataFrame, d: Draws) -> DataFrame:
    """Add ``y_season``: sine with harmonics, square or triangle wave, amplitude by segment, mean removed."""
    n = F.col("seq_len")
    df = df.withColumn("_segs", d.whole(1, 3, "season segments"))
    df = df.withColumn("season_borders", split_points(d, "season border", n, F.col("_segs")))
    heights = F.transform(F.sequence(F.lit(1), F.col("_segs").cast("int")), lambda k: d.between(1.0, 2.0, "season height", k) * F.col("overall_amplitude"))
    df = df.withColumn("season_heights", heights)
    flat = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: _segment_value(F.col("season_borders"), F.col("season_heights"), i))
    df = df.withColumn("_amp", flat)
    near = lambda i: F.slice("_amp", i - 1, 5)
    smooth = F.transform("_amp", lambda a, i: F.when((i >= 2) & (i <= n - 4), _mean(near(i))).otherwise(a))
    df = df.withColumn("_amp", smooth)
    time = lambda i: i * n / F.greatest(n - 1, F.lit(1))
    top = F.greatest(F.lit(2), F.least(F.floor(F.col("period") / 6), F.lit(10)))
    df = df.withColumn("_harmonics", d.whole(1, top - 1, "harmonics").cast("int"))
    two_pi = 2.0 * F.pi()

    def harmonic(k):
        return F.struct(
            k.alias("k"), d.between(0.0, 0.05, "wobble", k).alias("size"), (d.between(1.0, 3.0, "wobble speed", k) * F.pi()).alias("speed"),
            (d.between(0.0, 1.0, "wobble phase", k) * two_pi).alias("shift"), (two_pi / F.col("period") * k).alias("turn"), (d.uniform("phase", k) * two_pi).alias("phase"),
        )

    def sines(waves):  # drawn once per series, read at every step
        def sine(a, i):
            def wave(s, w):
                wobble = 1 + w["size"] * F.sin(w["speed"] * time(i) / n + w["shift"])
                return s + a / w["k"] * wobble * F.sin(w["turn"] * time(i) + w["phase"])

            return F.aggregate(waves, F.lit(0.0), wave)

        return F.transform("_amp", sine)

    start, square, tri = d.between(0.0, 0.3, "cycle start"), d.between(0.1, 0.3, "square width"), d.between(0.1, 0.6, "triangle width")
    cycle = lambda i: F.pmod(time(i), F.col("period")) / F.col("period")
    box = lambda a, i: F.when((cycle(i) >= start) & (cycle(i) < start + square), a).otherwise(0.0)

    def tent(a, i):
        c = cycle(i)
        up, down = a * 2 * (c - start) / tri, a * 2 * (start + tri - c) / tri
        return F.when((c >= start) & (c < start + tri), F.least(up, down)).otherwise(0.0)

    kind = F.col("season")
    raw = (
        F.when(F.startswith(kind, F.lit("no ")), F.transform("_amp", lambda a: F.lit(0.0)))
        .when(F.startswith(kind, F.lit("square")), F.transform("_amp", box))
        .when(F.startswith(kind, F.lit("triangle")), F.transform("_amp", tent))
        .otherwise(let(F.transform(F.sequence(F.lit(1), F.col("_harmonics")), harmonic), sines))
    )
    df = df.withColumn("_raw", raw)
    span, top = F.array_max("_raw") - F.array_min("_raw") + 1e-7, F.array_max("season_heights")
    df = df.withColumn("_raw", let(F.struct(span.alias("span"), top.alias("top")), lambda m: F.transform("_raw", lambda v: v / m["span"] * m["top"])))
    df = df.withColumn("y_season", let(_mean(F.col("_raw")), lambda mu: F.transform("_raw", lambda v: v - mu)))
    return df.drop("_segs", "_amp", "_harmonics", "_raw")


def curve(kind: Column, x: Column) -> Column:
    """One of four rising curves from 0 at x = 0."""
    return F.when(kind == 0, x * x).when(kind == 1, F.sin(x * F.pi() / 2)).when(kind == 2, x).otherwise(1.0 - (1.0 - x) * (1.0 - x))


def ramp(kind: Column, i: Column, length: Column) -> Column:
    """Share of a rise reached at step i of ``length`` steps; the last step reaches all of it."""
    return curve(kind, i / length) / (curve(kind, (length - 1) / length) + 1e-7)


# A change is a chain of phases (steps, level at its start, rise within it) in units of its amplitude, and the level that
# stays after it. Step ranges: "spike" sides and tops are drawn by weight; "share" grows with the series.
SHORT, SUDDEN, EDGE, TOP = (1, 5), (1, 10), (1, 4), (1, 3)
SLOW, CONVEX, WIDE, AFTER = ("share", 0.05, 8, 0.15, 20), ("share", 0.03, 6, 0.2, 16), ("share", 0.02, 4, 0.08, 8), ("after", 2, 0.05, 12)
SHAKE = ("shake", 8, 0.15, 16)
SPIKE = [("side", 0, 1), ("top", 1, 0), ("side", 1, -1)]
SHAPES = {
    "shake": (1, [(SHAKE, 0, "shake")], 0, 8),
    "upward spike": (1, SPIKE, 0, 3),
    "downward spike": (-1, SPIKE, 0, 3),
    "continuous upward spike": (1, "repeat", 0, 10),
    "continuous downward spike": (-1, "repeat", 0, 10),
    "upward convex": (1, [(EDGE, 0, 1), (CONVEX, 1, 0), (EDGE, 1, -1)], 0, 15),
    "downward convex": (-1, [(EDGE, 0, 1), (CONVEX, 1, 0), (EDGE, 1, -1)], 0, 15),
    "sudden increase": (1, [(SUDDEN, 0, 1)], "recover", 2),
    "sudden decrease": (-1, [(SUDDEN, 0, 1)], "recover", 2),
    "rapid rise followed by slow decline": (1, [(SHORT, 0, 1), (SLOW, 1, -1)], 0, 10),
    "slow rise followed by rapid decline": (1, [(SLOW, 0, 1), (SHORT, 1, -1)], 0, 10),
    "rapid decline followed by slow rise": (-1, [(SHORT, 0, 1), (SLOW, 1, -1)], 0, 10),
    "slow decline followed by rapid rise": (-1, [(SLOW, 0, 1), (SHORT, 1, -1)], 0, 10),
    "decrease after upward spike": (1, [*SPIKE, (AFTER, 0, "fall")], "fall", 8),
    "increase after downward spike": (-1, [*SPIKE, (AFTER, 0, "fall")], "fall", 8),
    "increase after upward spike": (1, [*SPIKE, (AFTER, 0, "climb")], "climb", 8),
    "decrease after downward spike": (-1, [*SPIKE, (AFTER, 0, "climb")], "climb", 8),
    "wide upward spike": (1, [(WIDE, 0, 1), (TOP, 1, 0), (WIDE, 1, -1)], 0, 16),
    "wide downward spike": (-1, [(WIDE, 0, 1), (TOP, 1, 0), (WIDE, 1, -1)], 0, 16),
}
STRONG = [n for n in SHAPES if "spike" in n]  # spikes draw larger amplitudes


def _laid_out(name: str) -> list:
    """Phases of one change type as rows: place, how steps are drawn, their range, level, rise, what the rise is a share of, repeat, noise."""
    _, shape, after, _ = SHAPES[name]

    def row(p, spec, level, rise, k=None):
        ranges = {"side": (0, 0, 0, 0), "top": (0, 0, 0, 0)}.get(spec)
        if ranges is None:
            ranges = spec[1:] if spec[0] == "share" else (0, spec[1], spec[2], spec[3]) if spec[0] in ("after", "shake", "gap", "back") else (0, spec[0], 0, spec[1])
        by = {"fall": ("side", -1), "climb": ("side", 1), "back": ("back", -1), "shake": ("one", 0.5)}.get(rise, ("one" if k is None else "size", rise))
        how = spec if isinstance(spec, str) else spec[0] if spec[0] in ("gap", "back") else "steps"
        return (p, how, *ranges, level, by[1], by[0], k, rise == "shake")

    if shape == "repeat":
        rows = []
        for k in range(5):
            rows.append(row(10 * k, ("gap", 0, 0, 3), 0, 0, k))
            rows += [row(10 * k + p, spec, level, rise, k) for p, (spec, level, rise) in enumerate(SPIKE)]
        return rows
    rows = [row(p, spec, level, rise) for p, (spec, level, rise) in enumerate(shape)]
    return rows + [row(9, ("back", 1, 0, 10), 1, "back")] if after == "recover" else rows


def _table() -> Column:
    """Every change type by name, as one literal map: a plan holds the draws of a phase once, whatever the number of types."""
    number, text = (lambda v: f"{float(v)!r}D"), (lambda v: f"'{v}'")

    def phase(r):
        p, how, low_share, low, high_share, high, level, rise, by, k, noisy = r
        return (
            f"named_struct('p', {p}, 'how', {text(how)}, 'low_share', {number(low_share)}, 'low', {low}, 'high_share', {number(high_share)}, 'high', {high}, "
            f"'level', {number(level)}, 'rise', {number(rise)}, 'by', {text(by)}, 'k', {-1 if k is None else k}, 'noisy', {str(noisy).lower()})"
        )

    entry = lambda name: (
        f"{text(name)}, named_struct('sign', {number(SHAPES[name][0])}, 'after', {text(SHAPES[name][2])}, 'least', {SHAPES[name][3]}, "
        f"'strong', {str(name in STRONG).lower()}, 'phases', array({', '.join(map(phase, _laid_out(name)))}))"
    )
    return F.expr(f"map({', '.join(map(entry, SHAPES))})")


# The draws of a change in the order of their numbers.
CHANGE_DRAWS = ["after share", "steps", "side", "curve", "top", "repeats", "repeat size", "gap", "recovers", "recovery", "recovery steps"]


def _phases(d: Draws, shape: Column, n: Column, j: int):
    """``(array of phase structs, level afterwards)`` of one row of the table, in units of its amplitude."""
    for name in CHANGE_DRAWS:
        d.names.setdefault(name, len(d.names) + 1)
    drawn = F.struct(
        d.between(0.1, 0.7, "after share", j).alias("side"), d.whole(2, 5, "repeats", j).alias("count"),
        F.when(d.uniform("recovers", j) < 0.5, d.between(0.0, 1.0 / 3.0, "recovery", j)).otherwise(0.0).alias("back"),
    )
    share = lambda s, least: F.greatest(F.floor(n * s), least)

    def phase(o, ph):
        how, p = ph["how"], ph["p"]
        steps = (
            F.when(how == "side", d.weighted(SPIKE_SIDE, "side", j, p)).when(how == "top", d.weighted(SPIKE_TOP, "top", j))
            .when(how == "gap", d.whole(0, 3, "gap", j, ph["k"])).when(how == "back", F.when(o["back"] > 0, d.whole(1, 10, "recovery steps", j)).otherwise(0))
            .otherwise(d.whole(share(ph["low_share"], ph["low"]), share(ph["high_share"], ph["high"]), "steps", j, p))
        )
        size = F.when(ph["k"] >= 0, d.between(0.6, 1.5, "repeat size", j, ph["k"])).otherwise(1.0)
        by = F.when(ph["by"] == "side", o["side"]).when(ph["by"] == "back", o["back"]).when(ph["by"] == "size", size).otherwise(1.0)
        return F.struct(
            F.when(ph["k"] < o["count"], steps).otherwise(0).cast("int").alias("steps"), (shape["sign"] * (ph["level"] * size)).alias("level"),
            (shape["sign"] * (ph["rise"] * by)).alias("rise"), F.when(ph["noisy"], 4).otherwise(d.whole(0, 3, "curve", j, p)).cast("int").alias("curve"),
        )

    after = shape["after"]

    def left(o):
        some = F.when(after == "recover", 1.0 - o["back"]).when(after == "climb", o["side"]).when(after == "fall", -o["side"])
        return F.when(after == "0", 0.0).otherwise(shape["sign"] * some)

    return let(drawn, lambda o: F.transform(shape["phases"], lambda ph: phase(o, ph))), let(drawn, left)


CHANGE_TYPE = "array<struct<position_start:int,position_end:int,type:string,amplitude:double,after:double,phases:array<struct<at:int,steps:int,level:double,rise:double,curve:int>>,no:int>>"


def with_changes(df: DataFrame, d: Draws) -> DataFrame:
    """Add ``changes``: placed changes with range, amplitude, phases and the level they leave, in order of position.

    A start is drawn from all positions that keep the least distance to the changes placed before; a change that fits
    nowhere is dropped. Every entry of ``change_types`` gets its turn, one round for each place in the array. A wanted start comes from ``change_positions`` when the row has that array.
    """
    n = F.col("seq_len").cast("int")
    wanted = F.col("change_positions") if "change_positions" in df.columns else F.array().cast("array<int>")
    placed = F.array().cast("array<struct<lo:int,hi:int>>")
    names, table = [], _table()
    most = df.agg(F.max(F.size("change_types"))).first()[0] or 0
    for j in range(most):
        kind = F.get("change_types", F.lit(j))
        df = df.withColumn("_shape", F.element_at(table, kind)).withColumn("_least", F.col("_shape.least"))
        apart = F.greatest(n / 8.0, F.col("_least"), F.lit(20))
        df = df.withColumn("_apart", apart).withColumn("_placed", placed)
        clear = lambda s: F.forall(
            "_placed",
            lambda o: ~((s >= o["lo"]) & (s < o["hi"])) & (F.abs(s + F.col("_least") - o["lo"]) >= F.col("_apart")) & (F.abs(s - o["hi"]) >= F.col("_apart")),
        )
        free = F.when(n >= F.col("_least"), F.filter(F.sequence(F.lit(0), n - F.col("_least")), clear))
        df = df.withColumn("_free", free)
        pick = F.get("_free", F.floor(d.uniform("start", j) * F.size("_free")).cast("int"))
        df = df.withColumn("_start", F.coalesce(F.get(wanted, F.lit(j)), pick))
        phases, after = _phases(d, F.col("_shape"), F.col("seq_len"), j)
        spread = F.when(F.col("_shape.strong"), 6.0).otherwise(2.0)
        size = (0.8 + F.abs(d.normal("size", j)) * spread) * F.col("overall_amplitude")
        if "change_sizes" in df.columns:
            size = F.coalesce(F.get("change_sizes", F.lit(j)), size)
        df = df.withColumn("_ph", phases).withColumn("_after", after)
        left = n - F.col("_start") - 1
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<at:int,steps:int,level:double,rise:double,curve:int>>").alias("out"))

        def lay(acc, ph):
            steps = F.greatest(F.lit(0), F.least(ph["steps"], F.col("_left") - acc["used"]))
            item = F.struct(
                (F.col("_start") + acc["used"]).cast("int").alias("at"), steps.cast("int").alias("steps"),
                ph["level"].alias("level"), ph["rise"].alias("rise"), ph["curve"].alias("curve"),
            )
            return F.struct((acc["used"] + steps).cast("int").alias("used"), F.concat(acc["out"], F.array(item)).alias("out"))

        df = df.withColumn("_left", left.cast("int")).withColumn("_laid", F.when(F.col("_start").isNotNull(), F.aggregate("_ph", start, lay)))
        end = (F.col("_start") + F.col("_laid.used")).cast("int")
        change = F.struct(
            F.col("_start").cast("int").alias("position_start"), end.alias("position_end"), kind.alias("type"), F.round(size, 4).alias("amplitude"),
            F.col("_after").alias("after"), F.col("_laid.out").alias("phases"), F.lit(j).alias("no"),
        )
        name = f"_c{j}"
        df = durable(df.withColumn(name, F.when(F.col("_laid").isNotNull(), change)).drop("_shape"))  # the next change builds on it
        names.append(name)
        box = F.when(F.col(name).isNotNull(), F.array(F.struct(F.col(f"{name}.position_start").alias("lo"), F.col(f"{name}.position_end").alias("hi")))).otherwise(
            F.array().cast("array<struct<lo:int,hi:int>>")
        )
        placed = F.concat(F.col("_placed"), box)
    if not names:
        return df.withColumn("changes", F.array().cast(CHANGE_TYPE))
    kept = F.array_sort(F.filter(F.array(*names), lambda c: c.isNotNull()))
    return df.withColumn("changes", kept).drop("_least", "_apart", "_placed", "_free", "_start", "_ph", "_after", "_left", "_laid", *names)


def with_local(df: DataFrame, d: Draws) -> DataFrame:
    """Add ``y_local``: the sum of all changes at each step."""

    def at_step(i):
        def one(change):
            def phase(s, ph):
                k = i - ph["at"]
                inside = (k >= 0) & (k < ph["steps"])
                grown = F.when(ph["curve"] == 4, 2 * d.uniform("shake", change["no"], i) - 1).otherwise(ramp(ph["curve"], k.cast("double"), ph["steps"].cast("double")))
                return s + F.when(inside, ph["level"] + ph["rise"] * grown).otherwise(0.0)

            past = F.when(i >= change["position_end"], change["after"]).otherwise(0.0)
            return change["amplitude"] * (F.aggregate(change["phases"], F.lit(0.0), phase) + past)

        return F.aggregate("changes", F.lit(0.0), lambda s, c: s + one(c))

    return df.withColumn("y_local", F.transform(F.sequence(F.lit(0), F.col("seq_len").cast("int") - 1), at_step))


def key_points(d: Draws, n: Column, name="turns") -> Column:
    """Two to five points ``(x, y)`` over the length, at least an eighth apart, y in [-1, 1]."""
    gap = F.ceil(n / 8)
    most = F.least(F.lit(3), F.floor((n - 1) / gap) - 1)
    turns = F.least(d.whole(0, 3, name), F.greatest(most, F.lit(0)))
    extra = n - 1 - (turns + 1) * gap
    share = lambda k: 0.05 + d.uniform(name + " share", k)
    index = F.sequence(F.lit(0), turns.cast("int"))
    total = F.aggregate(index, F.lit(0.0), lambda s, k: s + share(k))
    upto = lambda k: F.aggregate(F.filter(index, lambda q: q < k), F.lit(0.0), lambda s, q: s + share(q)) / total
    x = lambda k: F.when(k == turns + 1, n - 1).otherwise(k * gap + F.floor(extra * upto(k)))
    return F.transform(F.sequence(F.lit(0), turns.cast("int") + 1), lambda k: F.struct(x(k).cast("double").alias("x"), d.between(-1.0, 1.0, name + " height", k).alias("y")))


def monotone_curve(df: DataFrame, points: str, n: str, smooth: Column, out: str) -> DataFrame:
    """Add the values at steps 0..n-1 of the shape-preserving cubic through key points, or of straight lines."""
    p = F.col(points)
    last = F.size(p) - 1
    gap = lambda k: F.get(p, k + 1)["x"] - F.get(p, k)["x"]
    rise = lambda k: (F.get(p, k + 1)["y"] - F.get(p, k)["y"]) / gap(k)
    steps = F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.struct(gap(k).alias("h"), rise(k).alias("d")))
    df = df.withColumn("_steps", steps)
    h, d = (lambda k: F.get("_steps", k)["h"]), (lambda k: F.get("_steps", k)["d"])

    def inner(k):
        a, b = d(k - 1), d(k)
        w1, w2 = 2 * h(k) + h(k - 1), h(k) + 2 * h(k - 1)
        return F.when(a * b <= 0, 0.0).otherwise((w1 + w2) / (w1 / a + w2 / b))

    def edge(k, next):
        slope = ((2 * h(k) + h(next)) * d(k) - h(k) * d(next)) / (h(k) + h(next))

        def tame(v):
            flat = F.when(F.signum(v) != F.signum(d(k)), 0.0)
            return flat.when((F.signum(d(k)) != F.signum(d(next))) & (F.abs(v) > 3 * F.abs(d(k))), 3 * d(k)).otherwise(v)

        return let(slope, tame)

    tangents = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.when(last == 1, d(F.lit(0))).when(k == 0, edge(F.lit(0), F.lit(1))).when(k == last, edge(last - 1, last - 2)).otherwise(inner(k)),
    )
    df = df.withColumn("_tangents", F.when(p.isNotNull(), tangents))

    def value(i):
        def piece(k):
            s = (i - F.get(p, k)["x"]) / h(k)
            y0, y1 = F.get(p, k)["y"], F.get(p, k + 1)["y"]
            bent = let(s, lambda u: (
                y0 * (1 + 2 * u) * (1 - u) * (1 - u) + h(k) * F.get("_tangents", k) * u * (1 - u) * (1 - u)
                + y1 * u * u * (3 - 2 * u) + h(k) * F.get("_tangents", k + 1) * u * u * (u - 1)
            ))
            return F.when(F.col("_smooth"), bent).otherwise(y0 + (y1 - y0) * s)

        return let(F.greatest(F.lit(0), F.least(F.size(F.filter(p, lambda q: q["x"] <= i)) - 1, last - 1)), piece)

    df = df.withColumn("_smooth", smooth)
    curve_at = F.transform(F.sequence(F.lit(0), F.col(n).cast("int") - 1), lambda i: value(i))
    return df.withColumn(out, F.when(p.isNotNull(), curve_at)).drop("_steps", "_tangents", "_smooth")


def with_trend(df: DataFrame, d: Draws) -> DataFrame:
    """Add ``y_trend`` and ``points``: rise, fall, level, or a curve through key points."""
    n = F.col("seq_len")
    if "points" not in df.columns:
        df = df.withColumn("points", F.when(F.col("trend") == "multiple", key_points(d, n)))
    rise = d.between(0.8, 3.0, "trend rise") * F.col("overall_amplitude")
    rise = F.coalesce("trend_rise", rise) if "trend_rise" in df.columns else rise
    level = F.coalesce("trend_start", "overall_bias") if "trend_start" in df.columns else F.col("overall_bias")
    kind = d.whole(0, 3, "trend curve")
    index = F.sequence(F.lit(0), n.cast("int") - 1)
    sloped = lambda sign: F.transform(index, lambda i: sign * rise * ramp(kind, i.cast("double"), n.cast("double")) + level)
    df = monotone_curve(df, "points", "seq_len", d.uniform("smooth") < 0.99, "_curve")
    trend = (
        F.when(F.col("trend") == "increase", sloped(1.0))
        .when(F.col("trend") == "decrease", sloped(-1.0))
        .when(F.col("trend") == "multiple", F.transform("_curve", lambda v: v * rise))
        .otherwise(F.transform(index, lambda i: level))
    )
    return df.withColumn("y_trend", trend).drop("_curve")


def with_noise(df: DataFrame, d: Draws) -> DataFrame:
    """Add ``y_noise`` and ``noise_std``: Gaussian, or a dense mix of sines, with a gain per segment; or almost none."""
    n, amp = F.col("seq_len"), F.col("overall_amplitude")
    base = F.zip_with(F.zip_with("y_season", "y_local", lambda a, b: a + b), "y_trend", lambda a, b: a + b)
    df = df.withColumn("_base", base).withColumn("_moves", F.array_max("_base") - F.array_min("_base") > amp / 2)
    df = df.withColumn("_nseg", d.whole(1, 3, "noise segments"))
    df = df.withColumn("noise_borders", split_points(d, "noise border", n, F.col("_nseg")))
    df = df.withColumn("noise_gains", F.transform(F.sequence(F.lit(1), F.col("_nseg").cast("int")), lambda k: d.between(0.1, 5.0, "noise gain", k)))
    index = F.sequence(F.lit(0), n.cast("int") - 1)
    gain = lambda i: _segment_value(F.col("noise_borders"), F.col("noise_gains"), i)
    mixed = (d.uniform("noise kind") > 0.5) & F.col("_moves") & (F.col("frequency") == "no periodicity")
    waves = F.sequence(F.lit(1), F.lit(200))
    wave = lambda k: F.struct(
        d.between(50.0 / n, 200.0 / n, "noise speed", k).alias("speed"), (d.uniform("noise phase", k) * 2 * F.pi()).alias("phase"), d.between(0.3, 1.0, "noise size", k).alias("size"))
    summed = lambda ws: F.transform(index, lambda i: F.aggregate(ws, F.lit(0.0), lambda s, w: s + F.sin(w["speed"] * i + w["phase"]) * w["size"]))
    loud = F.col("noise") == "noisy"
    df = df.withColumn("_dense", F.when(loud & mixed, let(F.transform(waves, wave), summed)))
    span = F.array_max("_dense") - F.array_min("_dense") + 1e-7
    df = df.withColumn("_dense", let(span, lambda w: F.transform("_dense", lambda v: v / w * 0.2 * amp)))
    quiet = F.when(F.col("_moves"), d.between(0.0, 0.001, "quiet")).otherwise(0.0) * amp
    df = df.withColumn("noise_std", F.when(loud & mixed, 0.03 * amp).when(loud, d.between(0.03, 0.15, "noise std") * amp).otherwise(quiet))
    plain = lambda i: d.normal("noise", i) * F.col("noise_std")
    noise = (
        F.when(loud & mixed, let(_mean(F.col("_dense")), lambda mu: F.transform("_dense", lambda v, i: (v - mu + plain(i)) * gain(i))))
        .when(loud, F.transform(index, lambda i: plain(i) * gain(i)))
        .otherwise(F.transform(index, plain))
    )
    df = df.withColumn("y_noise", noise)
    return df.drop("_base", "_moves", "_nseg", "_dense")


def synthesise(attributes: DataFrame, seed=0, id="series_id") -> DataFrame:
    """Series ``y`` with components, changes and statistics from attribute rows."""
    d = Draws(seed + 17, id)
    df = durable(_with_scale(spread_out(attributes), d))
    df = durable(with_trend(with_local(with_changes(df, d), d), d))
    df = durable(with_noise(with_season(df, d), d))
    add = lambda a, b: F.zip_with(a, b, lambda x, v: x + v)
    df = df.withColumn("y", add(add("y_season", "y_local"), add("y_trend", "y_noise")))
    return df.drop("y_season", "y_local", "y_trend", "y_noise").withColumn("statistics", array_statistics("y"))


def array_statistics(y: str) -> Column:
    """Mean, deviation, extremes and their first positions of a packed series."""
    mean = _mean(F.col(y))
    spread = let(mean, lambda m: F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(y)))
    return F.struct(
        F.round(mean, 2).alias("mean"), F.round(spread, 2).alias("std"), F.round(F.array_max(y), 2).alias("max"), F.round(F.array_min(y), 2).alias("min"),
        (F.array_position(y, F.array_max(y)) - 1).alias("max_pos"), (F.array_position(y, F.array_min(y)) - 1).alias("min_pos"),
    )


# Correlated groups ---------------------------------------------------------------------------


def metric_groups(metrics: DataFrame, seed=0) -> DataFrame:
    """Members ``(system, metric, cluster, group_no)``: up to three clusters with at least two drawn metrics become
    groups 0, 1, 2, and up to five other metrics join with a NULL group.

    ``metrics(system, metric_id, metric, cluster)``; a system's metric list is a vocabulary of bounded size.
    """
    d, of = Draws(seed, "metric_id"), Draws(seed + 1, "system")
    seen = metrics.withColumn("_d", d.uniform("place"))
    chosen = seen.where(d.uniform("chosen") < 0.67)
    clusters = chosen.groupBy("system", "cluster").agg(F.count("*").alias("_n"), F.min("_d").alias("_cd")).where("_n >= 2")
    listed = clusters.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("_cd", "cluster"))).alias("_cs"))
    count = of.whole(1, 3, "groups").cast("int")
    groups = listed.select("system", F.posexplode(F.slice("_cs", F.lit(1), count)).alias("group_no", "_c")).select("system", "group_no", "_c.cluster")
    members = chosen.join(groups, ["system", "cluster"]).select("system", "metric_id", "metric", "cluster", "group_no")
    others = seen.join(members.select("system", "metric_id"), ["system", "metric_id"], "left_anti")
    few = others.groupBy("system").agg(F.array_sort(F.collect_list(F.struct("_d", "metric_id", "metric", "cluster"))).alias("_o"))
    some = of.whole(0, 5, "others").cast("int")
    extra = few.select("system", F.explode(F.slice("_o", F.lit(1), some)).alias("o")).select("system", "o.metric_id", "o.metric", "o.cluster", F.lit(None).cast("int").alias("group_no"))
    return members.unionByName(extra)


def shared_positions(members: DataFrame, length: int, seed=0, apart=6) -> DataFrame:
    """Add ``change_positions``: a common position per group, moved by up to ten steps per member; a fifth of the
    others get one change at least ``length / apart`` away from all groups, the rest none."""
    low, high = int(0.02 * length), int(0.95 * length)
    d, of = Draws(seed + 2, "metric_id"), Draws(seed + 3, "system")
    at = lambda g: low + F.floor((high - low) * (g + of.uniform("position", g) * 0.5) / 3)  # noqa: E731  groups stay apart
    near = d.whole(-10, 10, "near")
    own = F.greatest(F.lit(0), at(F.col("group_no")) + near).cast("int")
    far = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda p: F.forall(F.array(*[at(F.lit(g)) for g in range(3)]), lambda q: F.abs(p - q) > length // apart))
    lone = F.get(far, F.floor(d.uniform("lone") * F.size(far)).cast("int")).cast("int")
    empty = F.array().cast("array<int>")
    positions = F.when(F.col("group_no").isNotNull(), F.array(own)).when((d.uniform("has change") > 0.8) & lone.isNotNull(), F.array(lone)).otherwise(empty)
    return members.withColumn("change_positions", positions).withColumn("group_position", F.when(F.col("group_no").isNotNull(), at(F.col("group_no"))))


def shared_shapes(members: DataFrame, length: int, seed=0) -> DataFrame:
    """Add ``points``: key points shared by a group with a little jitter per member; others get a new curve, or the
    first group's with one point moved far."""
    d_group, d_own = Draws(seed, "_gid"), Draws(seed + 1, "metric_id")
    df = members.withColumn("_gid", F.col("system") * 4 + F.coalesce("group_no", F.lit(0))).withColumn("_n", F.lit(length))
    df = df.withColumn("_shared", key_points(d_group, F.col("_n"))).withColumn("_new", key_points(d_own, F.col("_n")))
    height = F.array_max(F.transform("_shared", lambda p: p["y"])) - F.array_min(F.transform("_shared", lambda p: p["y"]))
    m = F.size("_shared")
    inner = lambda k: (k > 0) & (k < m - 1)  # noqa: E731  the ends stay at the ends of the series
    jitter = F.transform("_shared", lambda p, k: F.struct(
        (p["x"] + F.when(inner(k), d_own.whole(-5, 5, "jitter x", k)).otherwise(0)).alias("x"), (p["y"] + d_own.between(-0.05, 0.05, "jitter y", k) * height).alias("y")))
    which = d_own.whole(0, m - 1, "moved")
    jump = F.when(d_own.uniform("up") < 0.5, -1.0).otherwise(1.0) * d_own.between(0.5, 1.0, "jump") * height
    moved = F.transform("_shared", lambda p, k: F.struct(p["x"].alias("x"), (p["y"] + F.when(k == which, jump).otherwise(0.0)).alias("y")))
    fresh = (d_own.uniform("different") > 0.7) | (m <= 3)
    points = F.when(F.col("group_no").isNotNull(), jitter).when(fresh, F.col("_new")).otherwise(moved)
    return df.withColumn("points", points).withColumn("trend", F.lit("multiple")).drop("_gid", "_n", "_shared", "_new")
