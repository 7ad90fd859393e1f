"""Time-series operators over long tables ``(key..., t, value)`` with an integer step ``t``."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.fourier import convolved
from tidewright.operators.scan import CHUNK, chunk_of, halo, scan
from tidewright.session import durable

CHUNK_ROWS = 100_000


def on_full_grid(obs: DataFrame, keys, t="t") -> DataFrame:
    """One row per step between the first and last observation of every key; missing values are NULL."""
    span = obs.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    grid = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(t))
    return grid.join(obs, [*keys, t], "left")


def interpolate(df: DataFrame, keys, t="t", value="value", out="filled", chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Linear interpolation of NULL gaps; both ends take the nearest value."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    marked = df.withColumn("_known", known)
    around = scan(marked, keys, t, chunk_of(t, chunk_rows), last={"_a": "_known"}, next={"_b": "_known"})
    share = (F.col(t) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    mixed = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), mixed)
        .otherwise(F.coalesce(F.col("_a.v"), F.col("_b.v")))
    )
    return around.withColumn(out, filled).drop("_known", "_a", "_b")


def series_stats(df: DataFrame, keys, t="t", value="value", digits=2) -> DataFrame:
    """Length, mean, population deviation, extremes and the first position of each extreme."""
    r = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(
        F.count("*").alias("seq_len"),
        r(F.avg(value)).alias("mean"),
        r(F.stddev_pop(value)).alias("std"),
        r(F.max(value)).alias("max"),
        r(F.min(value)).alias("min"),
        F.min_by(F.col(t), F.struct(-F.col(value), F.col(t))).alias("max_pos"),
        F.min_by(F.col(t), F.struct(F.col(value), F.col(t))).alias("min_pos"),
    )


def segments_for(length: Column) -> Column:
    """How many equal segments a series of this length is described by."""
    return F.when(length >= 64, 32).when(length >= 32, 16).otherwise(length).cast("bigint")


def segment_means(df: DataFrame, keys, t="t", value="value", digits=2) -> DataFrame:
    """Mean per equal segment; a remainder at the end is a segment of its own. ``t`` counts from 0."""
    lengths = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.floor(F.col("_n") / segments_for(F.col("_n"))).cast("bigint")
    placed = df.join(lengths, keys).withColumn("segment", F.floor(F.col(t) / step).cast("bigint"))
    return placed.groupBy(*keys, "segment").agg(F.round(F.avg(value), digits).alias("segment_mean"))


def exact_quantiles(df: DataFrame, keys, value: str, probs, block_rows=1_000_000, fan=64) -> DataFrame:
    """Exact linearly interpolated quantiles per key, as columns ``q0, q1, ...``.

    Equal values collapse to counts. While the ranges that hold the wanted ranks have more distinct values than a task
    should take, each is cut at ``fan`` approximate quantiles, the counts of the pieces are summed, and only the piece that
    holds a rank goes on. A running count then finds the ranks, so no task holds more than about ``block_rows`` values.
    """
    wanted, keys = list(keys), list(keys) or ["_all"]
    if not wanted:
        df = df.withColumn("_all", F.lit(0))
    counts = durable(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n")))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count("*").alias("_distinct"))
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p * (F.col("_total") - 1))
    ends = F.flatten(F.transform(at, lambda a, i: F.array(F.struct(i.alias("i"), F.floor(a).alias("pos")), F.struct(i.alias("i"), F.ceil(a).alias("pos")))))
    ranks = total.select(*keys, F.explode(ends).alias("r")).select(*keys, F.col("r.pos").cast("bigint").alias("pos")).distinct()
    # a range is a piece of the values of a key; below counts the rows before it
    ranges = ranks.withColumns({"_low": F.lit(None).cast(counts.schema["_v"].dataType), "_high": F.lit(None).cast(counts.schema["_v"].dataType), "below": F.lit(0).cast("bigint")})
    most = total.agg(F.max("_distinct")).first()[0] or 0
    inside = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    while most > block_rows:
        pieces = durable(ranges.select(*keys, "_low", "_high", "below").distinct())
        held = counts.join(pieces, keys).where(inside)
        cuts = held.groupBy(*keys, "below").agg(F.array_distinct(F.percentile_approx("_v", [i / fan for i in range(1, fan)], 10_000)).alias("_cuts"))
        cut = held.join(cuts, [*keys, "below"]).withColumn("_k", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
        cut = cut.groupBy(*keys, "_low", "_high", "below", "_k").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"), F.max(F.get("_cuts", F.col("_k") - 1)).alias("_from"), F.max(F.get("_cuts", F.col("_k"))).alias("_to"))
        before = F.sum("_rows").over(Window.partitionBy(*keys, "below").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))  # at most fan rows
        cut = cut.select(*keys, F.col("below").alias("_was"), F.coalesce("_from", "_low").alias("_l"), F.coalesce("_to", "_high").alias("_h"), (F.col("below") + F.coalesce(before, F.lit(0))).alias("_b"), "_rows", "_values")
        joined = ranges.join(cut, keys)
        joined = joined.where((F.col("below") == F.col("_was")) & (F.col("pos") >= F.col("_b")) & (F.col("pos") < F.col("_b") + F.col("_rows")))
        found = durable(joined.select(*keys, "pos", F.col("_l").alias("_low"), F.col("_h").alias("_high"), F.col("_b").alias("below"), "_values"))
        fewer = found.agg(F.max("_values")).first()[0]
        ranges = found.drop("_values")
        if fewer >= most:
            break  # the values can't be told apart any further
        most = fewer
    pieces = ranges.select(*keys, "_low", "_high", "below").distinct()
    line = Window.partitionBy(*keys, "below").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.join(pieces, keys).where(inside).withColumn("_upto", F.col("below") + F.sum("_n").over(line))
    spots = ranges.select(*keys, "pos", F.col("below").alias("_below"))
    hits = upto.join(spots, keys).where((F.col("below") == F.col("_below")) & (F.col("pos") >= F.col("_upto") - F.col("_n")) & (F.col("pos") < F.col("_upto")))
    values = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("pos", "_v"))).alias("_at"))  # two values a quantile
    outs = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.col("_at")[F.floor(spot)], F.col("_at")[F.ceil(spot)]
        outs.append((low + (high - low) * (spot - F.floor(spot))).alias(f"q{i}"))
    return values.join(total, keys).select(*wanted, *outs)


def numeric_profile(df: DataFrame, keys, value: str) -> DataFrame:
    """Range, mean, median, deviation and a Jarque-Bera normality verdict at the 5 % level."""
    n, skew, excess = F.count(value), F.skewness(value), F.kurtosis(value)
    jarque_bera = n / 6.0 * (skew * skew + excess * excess / 4.0)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (jarque_bera < CHI2_2_95).alias("is_normal"),
    )
    median = exact_quantiles(df, keys, value, [0.5]).withColumnRenamed("q0", "median")
    return base.join(median, list(keys))


# Fixed value: 95 % point of the chi-squared distribution with two degrees of freedom.
CHI2_2_95 = 5.991464547107979


def _longest(stats: DataFrame) -> int:
    return stats.agg(F.max("_n")).first()[0] or 0


def _shape(df: DataFrame, keys) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def autocorrelation(
    df: DataFrame, keys, t="t", value="value", max_lag=None, centred=True, block_rows=65_536
) -> DataFrame:
    """Autocorrelation of gap-free series for lags 1..max_lag (default half the length, and at most that).

    A series of up to ``block_rows`` points is transformed in one task. A longer one is the product of its transform with
    itself, spread over the cluster by rows and columns of a grid, so no task holds more than a block whatever the lag.
    A constant series has NULL throughout.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count("*").cast("bigint").alias("_n"), F.min(t).cast("bigint").alias("_lo"), (F.var_pop(value) * F.count("*")).alias("_var"))
    stats = durable(stats)
    half = F.floor(F.col("_n") / 2).cast("bigint")
    lags = half if max_lag is None else F.least(half, F.lit(int(max_lag)).cast("bigint"))
    shift = F.col("_mean") if centred else F.lit(0.0)
    sized = stats.withColumn("_lags", lags)
    dev = df.join(sized, keys).select(*keys, "_n", "_lags", (F.col(t) - F.col("_lo")).cast("bigint").alias("t"), (F.col(value) - shift).cast("double").alias("x"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        n, lags = int(pdf["_n"].iloc[0]), int(pdf["_lags"].iloc[0])
        x = np.zeros(n)
        x[pdf["t"].to_numpy()] = pdf["x"].to_numpy()
        size = n + lags + 1  # room for every lag, so that none wraps around
        f = np.fft.rfft(x, size)
        part = np.fft.irfft(np.conj(f) * f, size)[: lags + 1]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "lag": np.arange(len(part)), "sum": part})

    sums = dev.where(F.col("_n") <= block_rows).groupBy(*keys).applyInPandas(products, f"{_shape(df, keys)}lag bigint, sum double")
    if _longest(stats) > block_rows:
        long = dev.where(F.col("_n") > block_rows).withColumn("_room", F.col("_n") + F.col("_lags") + 1)
        sums = sums.unionByName(convolved(long, keys, "correlation", block_rows).select(*keys, F.col("pos").alias("lag"), F.col("re").alias("sum")))
    joined = sums.join(sized, keys).where((F.col("lag") >= 1) & (F.col("lag") <= F.col("_lags")))
    scaled = F.try_divide("sum", "_var") if centred else F.col("sum")
    return joined.select(*keys, "lag", scaled.alias("acf"))


def local_maxima(acf: DataFrame, keys, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Lags whose autocorrelation is above both neighbours."""
    around = scan(acf, keys, "lag", chunk_of("lag", chunk_rows), lag={"_p": "acf"}, lead={"_q": "acf"})
    return around.where((F.col("acf") > F.col("_p")) & (F.col("acf") > F.col("_q"))).drop("_p", "_q")


def best_peak(acf: DataFrame, keys, min_lag=10, share=0.1) -> DataFrame:
    """The highest local maximum with at least ``min_lag`` and ``share`` of the highest of all."""
    peaks = local_maxima(acf, keys)
    top = peaks.groupBy(*keys).agg(F.max("acf").alias("_top"))
    good = peaks.join(top, list(keys)).where((F.col("lag") >= min_lag) & (F.col("acf") >= share * F.col("_top")))
    return good.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("acf"), F.col("lag"))).alias("period"))


def spectrum(df: DataFrame, keys, t="t", value="value", block_rows=65_536) -> DataFrame:
    """``(keys..., _n, freq, re, im)``: the Fourier transform of gap-free series at the frequencies 1 .. _n / 2.

    A series of up to ``block_rows`` points is transformed in one task, a longer one of any length over the cluster.
    """
    keys = list(keys)
    stats = durable(df.groupBy(*keys).agg(F.count("*").cast("bigint").alias("_n"), F.min(t).cast("bigint").alias("_lo")))
    placed = df.join(stats, keys).select(*keys, "_n", (F.col(t) - F.col("_lo")).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"))

    def whole_series(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].iloc[0])
        x = np.zeros(n)
        x[pdf["t"].to_numpy()] = pdf["x"].to_numpy()
        k = np.arange(1, n // 2 + 1)
        f = np.fft.fft(x)[k]
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "_n": n, "freq": k, "re": f.real, "im": f.imag})

    out = placed.where(F.col("_n") <= block_rows).groupBy(*keys).applyInPandas(whole_series, f"{_shape(df, keys)}_n bigint, freq bigint, re double, im double")
    if _longest(stats) > block_rows:
        long = convolved(placed.where(F.col("_n") > block_rows).withColumn("_room", F.lit(0).cast("bigint")), keys, "spectrum", block_rows)
        long = long.join(stats.select(*keys, "_n"), keys).where((F.col("pos") >= 1) & (F.col("pos") <= F.floor(F.col("_n") / 2)))
        out = out.unionByName(long.select(*keys, "_n", F.col("pos").alias("freq"), "re", "im"))
    return out


def spectrum_period(df: DataFrame, keys, max_period: int, t="t", value="value", block_rows=65_536) -> DataFrame:
    """Period of the strongest frequency whose period does not exceed ``max_period``."""
    keys = list(keys)
    power = spectrum(df, keys, t, value, block_rows).where(F.col("_n") / F.col("freq") <= max_period)
    power = power.withColumn("_p", F.pow("re", F.lit(2)) + F.pow("im", F.lit(2)))
    best = power.groupBy(*keys, "_n").agg(F.min_by("freq", F.struct(-F.round("_p", 6), F.col("freq"))).alias("_freq"))
    # the reference point rounds half to even, as does bround
    return best.select(*keys, F.bround(F.col("_n") / F.col("_freq")).cast("bigint").alias("period"))


def choose_period(df: DataFrame, keys, length: int, min_points: int, min_windows: int, t="t", value="value") -> DataFrame:
    """Best autocorrelation peak below the longest usable period, else the spectrum, else that bound."""
    keys = list(keys)
    max_period = max(1, (length - min_points) // (min_windows - 1))
    acf = autocorrelation(df, keys, t, value, max_lag=max(2, min(max_period, length // 2)))
    peaks = local_maxima(acf, keys).where(F.col("lag") < max_period)
    by_acf = peaks.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("acf"), F.col("lag"))).alias("_acf"))
    by_fft = spectrum_period(df, keys, max_period, t, value).withColumnRenamed("period", "_fft")
    joined = df.select(*keys).distinct().join(by_acf, keys, "left").join(by_fft, keys, "left")
    period = F.coalesce("_acf", "_fft", F.lit(max_period)).cast("bigint")
    source = F.when(F.col("_acf").isNotNull(), "acf").when(F.col("_fft").isNotNull(), "spectrum").otherwise("bound")
    repeats = F.greatest(F.lit(1), F.floor((F.lit(min_points) + F.col("period") - 1) / F.col("period")))
    return (
        joined.select(*keys, period.alias("period"), source.alias("source"))
        .withColumn("window_length", (repeats * F.col("period")).cast("bigint"))
    )


def most_frequent_period(periods: DataFrame, order: str, period="period") -> DataFrame:
    """One row: the period most channels share; the earliest channel decides ties."""
    votes = periods.groupBy(period).agg(F.count("*").alias("votes"), F.min(order).alias("first_channel"))
    return votes.agg(
        F.min_by(F.struct(F.col(period).alias("period"), F.col("votes")), F.struct(-F.col("votes"), F.col("first_channel"))).alias("s")
    ).select("s.period", "s.votes")


def window_plan(n: Column, period, window_length, min_windows: int, split: str) -> dict[str, Column]:
    """Training windows of a series of ``n`` points: window i starts at min(i * step, top), i < count, and perhaps one more at ``extra``."""
    n, period, length = n.cast("bigint"), F.lit(period).cast("bigint"), F.lit(window_length).cast("bigint")
    div = lambda a, b: F.floor(a / b).cast("bigint")
    last, many, none = n - length, F.lit(min_windows).cast("bigint"), F.lit(None).cast("bigint")
    top = F.greatest(last, F.lit(0))
    if split == "no-periodicity":
        one = F.lit(min_windows <= 1) | (last <= 0)
        step = F.when(one, 0).otherwise(div(last, F.lit(max(min_windows - 1, 1))))
        return {"count": F.when(one, 1).otherwise(many), "step": step, "top": top, "extra": none}
    if split == "maximize-overlap":
        return {"count": F.when(last < 0, 0).otherwise(div(last, period) + 1), "step": period, "top": top, "extra": none}
    if split != "minimize-overlap":
        raise ValueError(f"unknown split {split}")
    whole = lambda x: F.greatest(F.lit(1), div(x, period)) * period
    enough = div(n, length) >= many
    step = F.when(enough, whole(length)).otherwise(whole(F.greatest(F.lit(1), F.ceil(last / F.lit(max(min_windows - 1, 1))).cast("bigint"))))
    count = F.when(enough, F.greatest(div(last, step) + 1, F.lit(0))).otherwise(many)
    covered = length + (count - 1) * step
    extra = F.when(n - covered > period, covered + div(n - covered, period) * period - length)
    return {"count": count, "step": step, "top": top, "extra": extra}


def cut_windows(df: DataFrame, keys, n, period, window_length, min_windows, split, t="t", value="value") -> DataFrame:
    """Rows ``(key, window, pos, value)`` of every training window.

    ``n`` is the number of points of every series, or None to count each. A point finds the windows that cover it by
    arithmetic on ``t``, so long series cost no more per point than short ones.
    """
    keys = list(keys)
    if n is None:
        sizes = df.groupBy(*keys).agg((F.max(t) + 1).cast("bigint").alias("_n"))
        df = df.join(sizes, keys)
    else:
        df = df.withColumn("_n", F.lit(n).cast("bigint"))
    df = df.withColumns({f"_{k}": c for k, c in window_plan(F.col("_n"), period, window_length, min_windows, split).items()})
    low = F.when(F.col("_step") > 0, F.greatest(F.floor((F.col(t) - window_length) / F.col("_step")) + 1, F.lit(0))).otherwise(0).cast("bigint")
    # windows pushed back to the top all begin there; the others begin at or before t
    free = F.when(F.col("_step") > 0, F.floor(F.col(t) / F.col("_step"))).otherwise(F.col("_count"))
    high = F.least(F.col("_count") - 1, F.when((F.col("_count") - 1) * F.col("_step") > F.col("_top"), F.col("_count")).otherwise(free)).cast("bigint")
    pushed = F.when((F.col("_count") - 1) * F.col("_step") > F.col("_top"), F.lit(0).cast("bigint")).otherwise(low)
    at = lambda i: F.struct(i.alias("window"), F.least(i * F.col("_step"), F.col("_top")).alias("start"))
    found = F.when(pushed <= high, F.transform(F.sequence(pushed, high), at)).otherwise(F.array().cast("array<struct<window:bigint,start:bigint>>"))
    more = F.when(F.col("_extra").isNotNull(), F.array(F.struct(F.col("_count").alias("window"), F.col("_extra").alias("start")))).otherwise(F.array().cast("array<struct<window:bigint,start:bigint>>"))
    covering = F.filter(F.concat(found, more), lambda s: (s["start"] <= F.col(t)) & (F.col(t) < s["start"] + window_length))
    hit = df.withColumn("_w", F.explode(covering))
    return hit.select(*keys, F.col("_w.window").alias("window"), (F.col(t) - F.col("_w.start")).alias("pos"), F.col(value).alias("value"))


def fit_scaler(windows: DataFrame, keys) -> DataFrame:
    """Mean and population deviation per key and window position; a zero deviation counts as one."""
    fit = windows.groupBy(*keys, "pos").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return fit.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def scale(windows: DataFrame, fit: DataFrame, keys) -> DataFrame:
    return windows.join(fit, [*keys, "pos"]).withColumn("scaled", (F.col("value") - F.col("mu")) / F.col("sd"))


def unscale(rows: DataFrame, fit: DataFrame, keys, scaled="scaled") -> DataFrame:
    return rows.join(fit, [*keys, "pos"]).withColumn("restored", F.col(scaled) * F.col("sd") + F.col("mu"))


def smooth_five(df: DataFrame, keys, t="t", value="value", chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Five-point mean inside a series; the first two and last three points stay as they are."""
    lengths = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    wide = halo(df.join(lengths, list(keys)), t, chunk_rows, 2)
    w = Window.partitionBy(*keys, CHUNK).orderBy(t).rowsBetween(-2, 2)
    inside = (F.col(t) >= 2) & (F.col(t) <= F.col("_n") - 4)
    out = wide.withColumn("smooth", F.when(inside, F.avg(value).over(w)).otherwise(F.col(value)))
    return out.where("_own").drop(CHUNK, "_own", "_n")


def decompose(df: DataFrame, periods: DataFrame, keys, t="t", value="value", default_period=20, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Trend (centred mean over one period), season (phase mean) and remainder of gap-free series.

    The frame differs per series, so the mean comes from two look-ups in a running total.
    """
    keys = list(keys)
    lengths = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = lengths.join(periods.select(*keys, "period"), keys, "left").withColumn(
        "period", F.coalesce("period", F.lit(default_period)).cast("bigint")
    )
    sized_rows = df.select(*keys, t, value).join(sized, keys)
    base = durable(scan(sized_rows, keys, t, chunk_of(t, chunk_rows), cumsum={"_sum": value}))
    half = F.floor(F.col("period") / 2).cast("bigint")
    edges = base.withColumn("_hi", F.least(F.col(t) + half, F.col("_n") - 1)).withColumn("_lo", F.greatest(F.col(t) - half, F.lit(0)))
    total = base.select(*keys, F.col(t).alias("_at"), F.col("_sum").alias("_tot"))
    hi = total.withColumnsRenamed({"_at": "_hi", "_tot": "_hi_sum"})
    lo = total.select(*keys, (F.col("_at") + 1).alias("_lo"), F.col("_tot").alias("_lo_sum"))
    joined = edges.join(hi, [*keys, "_hi"]).join(lo, [*keys, "_lo"], "left")
    trend = (F.col("_hi_sum") - F.coalesce("_lo_sum", F.lit(0.0))) / (F.col("_hi") - F.col("_lo") + 1)
    trended = durable(joined.withColumn("trend", trend).withColumn("_phase", F.col(t) % F.col("period")))
    rest = F.col(value) - F.col("trend")
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(rest).alias("_phase_mean"), F.count("*").alias("_c"))
    level = phases.groupBy(*keys).agg((F.sum(F.col("_phase_mean")) / F.count("*")).alias("_level"))
    seasonal = phases.join(level, keys).select(*keys, "_phase", (F.col("_phase_mean") - F.col("_level")).alias("season"))
    out = trended.join(seasonal, [*keys, "_phase"])
    return out.select(*keys, t, value, "period", "trend", "season", (rest - F.col("season")).alias("rest"))


def autoregressive_anomalies(df: DataFrame, keys, t="t", value="value", fence=3.0, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Points whose one-step regression residual leaves the quartile fence; ``opens`` marks run starts."""
    keys = list(keys)
    pairs = scan(df.select(*keys, t, value), keys, t, chunk_of(t, chunk_rows), lag={"_prev": value})
    fit = pairs.groupBy(*keys).agg(
        F.regr_slope(value, "_prev").alias("_slope"), F.regr_intercept(value, "_prev").alias("_icpt")
    )
    resid = pairs.join(fit, keys).withColumn("resid", F.col(value) - (F.col("_icpt") + F.col("_slope") * F.col("_prev")))
    resid = durable(resid.drop("_prev", "_slope", "_icpt"))
    q = exact_quantiles(resid, keys, "resid", [0.25, 0.75])
    low = F.col("q0") - fence * (F.col("q1") - F.col("q0"))
    high = F.col("q1") + fence * (F.col("q1") - F.col("q0"))
    flagged = resid.join(q, keys).withColumn("is_anomaly", F.coalesce((F.col("resid") < low) | (F.col("resid") > high), F.lit(False)))
    out = scan(flagged.drop("q0", "q1"), keys, t, chunk_of(t, chunk_rows), lag={"_was": "is_anomaly"})
    return out.withColumn("opens", F.col("is_anomaly") & ~F.coalesce("_was", F.lit(False))).drop("_was")


def correlation_with(df: DataFrame, source: str, key="series_id", t="t", value="value") -> DataFrame:
    """Pearson correlation of one series with each other one over their common length."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    common = df.where(F.col(t) < n.agg(F.min("n")).scalar())
    left = common.where(F.col(key) == source).select(t, F.col(value).alias("_x"))
    right = common.where(F.col(key) != source)
    return right.join(left, t).groupBy(key).agg(F.corr("_x", value).alias("correlation"))


def fluctuation_match(marks: DataFrame, source: str, tolerance: int, key="series_id", t="t") -> DataFrame:
    """Share of the source's marks with a mark of the other series within ``tolerance`` steps.

    Marks are summarised by buckets as wide as the tolerance; the first and last mark of three
    neighbouring buckets decide, so dense series do not multiply rows.
    """
    width = max(1, tolerance)
    bucket = chunk_of(t, width)
    mine = marks.where(F.col(key) == source).select(F.col(t).alias("_p"), bucket.alias("_b"))
    total = F.greatest(mine.agg(F.count("*")).scalar(), F.lit(1))
    others = marks.where(F.col(key) != source)
    cells = others.groupBy(key, bucket.alias("_cell")).agg(F.min(t).alias("_first"), F.max(t).alias("_last"))
    probes = mine.withColumn("_cell", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    near = (F.abs(F.col("_p") - F.col("_first")) <= tolerance) | (F.abs(F.col("_p") - F.col("_last")) <= tolerance)
    same = (F.col("_cell") == F.col("_b")) & (F.lit(tolerance) > 0)
    hits = probes.join(cells, "_cell").where(near | same).select(key, "_p").distinct()
    matched = hits.groupBy(key).agg(F.count("*").alias("matched"))
    return others.select(key).distinct().join(matched, key, "left").select(
        key, F.coalesce("matched", F.lit(0)).alias("matched"), (F.coalesce("matched", F.lit(0)) / total).alias("match_ratio")
    )


def centred_window(df: DataFrame, centres: DataFrame, keys, width=64, t="t", value="value") -> DataFrame:
    """A window of ``width`` points around each centre, moved inside the series bounds; a shorter series gives none.

    Further columns of ``centres`` come along.
    """
    keys = list(keys)
    more = [c for c in centres.columns if c not in (*keys, "centre")]
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    start = F.least(F.greatest(F.lit(0), F.col("centre") - width // 2), F.col("_n") - width)
    spots = centres.join(n, keys).where(F.col("_n") >= width).withColumn("_start", start)
    steps = spots.withColumn(t, F.explode(F.sequence(F.col("_start"), F.col("_start") + width - 1)))
    return steps.join(df.select(*keys, t, value), [*keys, t]).select(
        *keys, "centre", *more, (F.col(t) - F.col("_start")).alias("pos"), F.col(value).alias("value")
    )


def labelled_windows(df: DataFrame, changes: DataFrame, keys, label: str, width=64, t="t", value="value") -> DataFrame:
    """``(keys..., change_no, label, x)``: a training window around the middle of every change, as one array.

    ``changes(keys..., change_no, label, start, end)``. Windows are moved inside the series; a shorter series gives none.
    """
    middle = changes.select(*keys, "change_no", F.col(label), F.floor((F.col("start") + F.col("end")) / 2).cast("bigint").alias("centre"))
    points = centred_window(df, middle, keys, width, t, value)
    packed = points.groupBy(*keys, "change_no", label).agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    return packed.select(*keys, "change_no", label, F.col("p.value").alias("x"))


def slice_range(df: DataFrame, start: int, end: int, t="t") -> DataFrame:
    """Rows with ``start <= t < end``; raises when the data is shorter than asked."""
    if start < 0:
        raise ValueError("start must not be negative")
    top = df.agg(F.max(t)).scalar()
    enough = F.when(top + 1 >= end, True).otherwise(
        F.raise_error(F.lit(f"not enough data for the range {start} to {end}")).cast("boolean")
    )
    return df.where((F.col(t) >= start) & (F.col(t) < end) & enough)


def trend_segments(points: DataFrame, keys, seq_len) -> DataFrame:
    """Direction of each stretch between key points ``(x, y)``, equal neighbours merged.

    ``seq_len`` is the length of all series, or the column of ``points`` that holds the length of each.

    A stretch counts as rising or falling when it moves by more than a tenth of the curve's range.
    Key points are few per curve by construction, so each curve fits one sorted array.
    """
    keys = list(keys)
    curve = points.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("x"), F.col("y")))).alias("p"), (F.max("y") - F.min("y")).alias("_range"),
        F.max(F.col(seq_len) if isinstance(seq_len, str) else F.lit(seq_len)).alias("_len"),
    )
    span = F.when(F.col("_range") == 0, 1.0).otherwise(F.col("_range"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("p") - 1),
        lambda i: F.struct(
            F.element_at("p", i)["x"].alias("from"),
            F.element_at("p", i + 1)["x"].alias("to"),
            F.when(F.element_at("p", i + 1)["y"] - F.element_at("p", i)["y"] > 0.1 * span, "increase")
            .when(F.element_at("p", i + 1)["y"] - F.element_at("p", i)["y"] < -0.1 * span, "decrease")
            .otherwise("steady")
            .alias("trend"),
        ),
    )
    kept = F.filter("_steps", lambda s, i: (i == 0) | (s["trend"] != F.get("_steps", i - 1)["trend"]))
    merged = curve.withColumn("_steps", steps).withColumn("_kept", kept)
    ends = merged.select(*keys, F.posexplode("_kept").alias("segment", "_s"), "_kept", "_len")
    stop = F.coalesce(F.get("_kept", F.col("segment") + 1)["from"], F.col("_len") - 1)
    return ends.select(*keys, "segment", F.col("_s.trend").alias("trend"), F.col("_s.from").alias("start"), stop.alias("end"))
