"""Time-series queries: gap filling, statistics, periods, windows, scaling, decomposition, anomalies."""

from pyspark.sql import functions as F

from tidewright.operators import series
from tidewright.plans.inputs import DAILY_SQL, HOURLY_GAPS_SQL, HOURLY_SQL, daily_by_segment, hourly, hourly_gaps
from tidewright.plans.registry import query

KEY = ["series_id"]


@query(
    "series_profile",
    f"""WITH {HOURLY_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
seg AS (
  SELECT series_id, CAST(t // (n // CASE WHEN n >= 64 THEN 32 WHEN n >= 32 THEN 16 ELSE n END) AS BIGINT) AS segment,
         round(avg(value), 6) AS segment_mean FROM sized GROUP BY 1, 2),
stat AS (
  SELECT series_id, count(*) AS seq_len, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
         round(max(value), 6) AS max, round(min(value), 6) AS min
  FROM hourly GROUP BY 1)
SELECT s.series_id, seq_len, mean, std, max, min, segment, segment_mean FROM stat s JOIN seg USING (series_id)""",
)
def series_profile(t):
    base = hourly(t)
    stats = series.series_stats(base, KEY, digits=6).drop("max_pos", "min_pos")
    return stats.join(series.segment_means(base, KEY, digits=6), "series_id")


@query("interpolate_gaps", f"WITH {HOURLY_SQL} SELECT series_id, t, raw AS value, round(value, 6) AS filled FROM filled")
def interpolate_gaps(t):
    return series.interpolate(hourly_gaps(t), KEY).withColumn("filled", F.round("filled", 6))


@query(
    "series_stats",
    f"""WITH {HOURLY_SQL},
hi AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY value DESC, t) AS rn FROM hourly),
lo AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY value, t) AS rn FROM hourly)
SELECT h.series_id, count(*) AS seq_len, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std,
       round(max(value), 2) AS max, round(min(value), 2) AS min, max(hi.t) AS max_pos, max(lo.t) AS min_pos
FROM hourly h JOIN hi ON hi.series_id = h.series_id AND hi.rn = 1 JOIN lo ON lo.series_id = h.series_id AND lo.rn = 1
GROUP BY 1""",
)
def series_stats(t):
    return series.series_stats(hourly(t), KEY)


@query(
    "segment_means",
    f"""WITH {DAILY_SQL}, pos AS (
  SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, value,
         count(*) OVER (PARTITION BY series_id) AS n FROM daily)
SELECT series_id, CAST(t // (n // CASE WHEN n >= 64 THEN 32 WHEN n >= 32 THEN 16 ELSE n END) AS BIGINT) AS segment,
       round(avg(value) + 1e-7, 2) AS segment_mean FROM pos GROUP BY 1, 2""",
)
def segment_means(t):
    daily = daily_by_segment(t).withColumn("one", F.lit(1))
    ranked = series.scan(daily, KEY, "t", series.chunk_of("t", 10_000), cumsum={"rn": "one"})
    exact = series.segment_means(ranked.select("series_id", (F.col("rn") - 1).alias("t"), "value"), KEY, digits=9)
    return exact.withColumn("segment_mean", F.round(F.col("segment_mean") + 1e-7, 2))


@query(
    "price_quantiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q0, quantile_cont(l_extendedprice, 0.5) AS q1,
       quantile_cont(l_extendedprice, 0.75) AS q2 FROM lineitem GROUP BY 1""",
)
def price_quantiles(t):
    return series.exact_quantiles(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])


@query(
    "numeric_profile",
    """WITH m AS (
  SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS min, max(c_acctbal) AS max, avg(c_acctbal) AS mean,
         stddev_pop(c_acctbal) AS std, quantile_cont(c_acctbal, 0.5) AS median FROM customer GROUP BY 1),
k AS (
  SELECT c_mktsegment, avg(((c_acctbal - mean) / std) ** 3) AS s, avg(((c_acctbal - mean) / std) ** 4) - 3 AS e
  FROM customer JOIN m USING (c_mktsegment) GROUP BY 1)
SELECT c_mktsegment, n, min, max, round(mean, 4) AS mean, round(std, 4) AS std, round(median, 4) AS median,
       n / 6.0 * (s * s + e * e / 4.0) < 5.991464547107979 AS is_normal FROM m JOIN k USING (c_mktsegment)""",
)
def numeric_profile(t):
    prof = series.numeric_profile(t.customer.select("c_mktsegment", "c_acctbal"), ["c_mktsegment"], "c_acctbal")
    return prof.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query("categorical_profile", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def categorical_profile(t):
    return t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


ACF_SQL = f"""{HOURLY_SQL},
m AS (SELECT series_id, avg(value) AS mu, count(*) AS n FROM hourly GROUP BY 1),
d AS (SELECT h.series_id, t, value - mu AS x, value AS raw, n FROM hourly h JOIN m USING (series_id)),
acf AS (
  SELECT a.series_id, b.t - a.t AS lag, sum(a.x * b.x) / max(v.var) AS acf, sum(a.raw * b.raw) AS raw_acf
  FROM d a JOIN d b ON a.series_id = b.series_id AND b.t > a.t AND b.t - a.t <= a.n // 2
  JOIN (SELECT series_id, sum(x * x) AS var FROM d GROUP BY 1) v ON v.series_id = a.series_id
  GROUP BY 1, 2)"""

PEAK_SQL = """
peaks AS (
  SELECT series_id, lag, acf FROM (
    SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM acf WINDOW w AS (PARTITION BY series_id ORDER BY lag))
  WHERE acf > p AND acf > q)"""


@query("autocorrelation", f"WITH {ACF_SQL} SELECT series_id, lag, round(acf, 6) AS acf FROM acf")
def autocorrelation(t):
    return series.autocorrelation(hourly(t), KEY).withColumn("acf", F.round("acf", 6))


@query(
    "acf_peaks",
    f"""WITH {ACF_SQL}, {PEAK_SQL}
SELECT series_id, lag, round(acf, 6) AS acf, row_number() OVER (PARTITION BY series_id ORDER BY acf DESC, lag) AS peak_rank FROM peaks""",
)
def acf_peaks(t):
    peaks = series.local_maxima(series.autocorrelation(hourly(t), KEY), KEY)
    w = series.Window.partitionBy("series_id").orderBy(F.desc("acf"), "lag")
    return peaks.select("series_id", "lag", F.round("acf", 6).alias("acf"), F.row_number().over(w).cast("bigint").alias("peak_rank"))


RAW_PERIOD_SQL = f"""{ACF_SQL},
rawpeaks AS (
  SELECT series_id, lag, raw_acf FROM (
    SELECT *, lag(raw_acf) OVER w AS p, lead(raw_acf) OVER w AS q FROM acf WINDOW w AS (PARTITION BY series_id ORDER BY lag))
  WHERE raw_acf > p AND raw_acf > q),
best AS (
  SELECT series_id, lag AS period FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY raw_acf DESC, lag) AS rn FROM (
      SELECT *, max(raw_acf) OVER (PARTITION BY series_id) AS top FROM rawpeaks)
    WHERE lag >= 10 AND raw_acf >= 0.1 * top) WHERE rn = 1)"""


@query("best_acf_peak", f"WITH {RAW_PERIOD_SQL} SELECT series_id, period FROM best")
def best_acf_peak(t):
    return series.best_peak(series.autocorrelation(hourly(t), KEY, centred=False), KEY)


@query(
    "spectrum_period",
    f"""WITH {HOURLY_SQL}, s AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
k AS (SELECT series_id, n, unnest(range(1, n // 2 + 1)) AS k FROM s),
p AS (
  SELECT k.series_id, k.n, k.k, round(pow(sum(value * cos(2 * pi() * k.k * t / k.n)), 2) + pow(sum(value * sin(2 * pi() * k.k * t / k.n)), 2), 6) AS p
  FROM k JOIN hourly h ON h.series_id = k.series_id WHERE k.n / k.k <= 60 GROUP BY 1, 2, 3)
SELECT series_id, CAST(round_even(n / k, 0) AS BIGINT) AS period FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p DESC, k) AS rn FROM p) WHERE rn = 1""",
)
def spectrum_period(t):
    return series.spectrum_period(hourly(t), KEY, max_period=60)


@query("choose_period")
def choose_period(t):
    base = hourly(t)
    longest = base.agg(F.max("t")).first()[0] + 1
    return series.choose_period(base, KEY, length=longest, min_points=300, min_windows=10)


@query(
    "common_period",
    f"""WITH {RAW_PERIOD_SQL}, votes AS (SELECT period, count(*) AS votes, min(series_id) AS c FROM best GROUP BY 1)
SELECT period, votes FROM votes ORDER BY votes DESC, c LIMIT 1""",
)
def common_period(t):
    periods = series.best_peak(series.autocorrelation(hourly(t), KEY, centred=False), KEY)
    return series.most_frequent_period(periods, "series_id")


def _cut_sql(plan):
    """``plan`` selects series_id, "window", start from ``lens(series_id, n)``."""
    return f"""WITH {HOURLY_SQL}, lens AS (SELECT series_id, max(t) + 1 AS n FROM hourly GROUP BY 1), starts AS ({plan})
SELECT c.series_id, s."window", c.t - s.start AS pos, round(c.value + 1e-9, 6) AS value
FROM hourly c JOIN starts s ON s.series_id = c.series_id AND c.t >= s.start AND c.t < s.start + 200"""


def _least_overlap_sql(wanted):
    return f"""SELECT series_id, i AS "window", least(i * step, n - 200) AS start FROM (SELECT *, unnest(range(0, cnt)) AS i FROM p)
UNION ALL SELECT series_id, cnt, cover + (n - cover) // 24 * 24 - 200 FROM (SELECT *, 200 + (cnt - 1) * step AS cover FROM p) WHERE n - cover > 24""", f"""p AS (
  SELECT series_id, n, step, CASE WHEN n // 200 >= {wanted} THEN (n - 200) // step + 1 ELSE {wanted} END AS cnt FROM (
    SELECT *, CASE WHEN n // 200 >= {wanted} THEN 192 ELSE greatest(1, greatest(1, CAST(ceil((n - 200) / {wanted - 1}.0) AS BIGINT)) // 24) * 24 END AS step FROM lens))"""


def _cut_least_sql(wanted):
    starts, plan = _least_overlap_sql(wanted)
    return _cut_sql("SELECT * FROM lens").replace("starts AS (SELECT * FROM lens)", f"{plan}, starts AS ({starts})")


def _cut(t, split, period=24, min_windows=5):
    windows = series.cut_windows(hourly(t), KEY, None, period, 200, min_windows, split)
    return windows.withColumn("value", F.round(F.col("value") + 1e-9, 6))


@query("windows_even", _cut_sql('SELECT series_id, i AS "window", i * ((n - 200) // 4) AS start FROM (SELECT *, unnest(range(0, 5)) AS i FROM lens)'))
def windows_even(t):
    return _cut(t, "no-periodicity")


@query("windows_max_overlap", _cut_sql('SELECT series_id, i AS "window", i * 24 AS start FROM (SELECT *, unnest(range(0, (n - 200) // 24 + 1)) AS i FROM lens)'))
def windows_max_overlap(t):
    return _cut(t, "maximize-overlap")


@query("windows_min_overlap", _cut_least_sql(5))
def windows_min_overlap(t):
    return _cut(t, "minimize-overlap")


@query("windows_min_overlap_tail", _cut_least_sql(3))
def windows_min_overlap_tail(t):
    return _cut(t, "minimize-overlap", min_windows=3)


SCALE_SQL = f"""{HOURLY_SQL},
lens AS (SELECT series_id, max(t) + 1 AS n FROM hourly GROUP BY 1),
w AS (SELECT h.series_id, s.i AS "window", t - s.i * 24 AS pos, value FROM hourly h
      JOIN (SELECT series_id, unnest(range(0, (n - 200) // 24 + 1)) AS i FROM lens) s ON h.series_id = s.series_id AND t >= s.i * 24 AND t < s.i * 24 + 200),
fit AS (SELECT series_id, pos, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM w GROUP BY 1, 2)"""


@query("scaler_fit", f"WITH {SCALE_SQL} SELECT series_id, pos, round(mu, 6) AS mu, round(sd, 6) AS sd FROM fit")
def scaler_fit(t):
    windows = series.cut_windows(hourly(t), KEY, None, 24, 200, 5, "maximize-overlap")
    return series.fit_scaler(windows, KEY).withColumns({"mu": F.round("mu", 6), "sd": F.round("sd", 6)})


@query(
    "scaler_round_trip",
    f"""WITH {SCALE_SQL} SELECT series_id, "window", pos, round((value - mu) / sd + 1e-9, 5) AS scaled, round(value + 1e-9, 6) AS restored
FROM w JOIN fit USING (series_id, pos)""",
)
def scaler_round_trip(t):
    windows = series.cut_windows(hourly(t), KEY, None, 24, 200, 5, "maximize-overlap")
    fit = series.fit_scaler(windows, KEY)
    scaled = series.scale(windows, fit, KEY).select("series_id", "window", "pos", "scaled")
    back = series.unscale(scaled, fit, KEY)
    return back.select("series_id", "window", "pos", F.round(F.col("scaled") + 1e-9, 5).alias("scaled"), F.round(F.col("restored") + 1e-9, 6).alias("restored"))


@query(
    "moving_average",
    f"""WITH {HOURLY_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hourly)
SELECT series_id, t, round(value, 6) AS value, round(CASE WHEN t >= 2 AND t <= n - 4 THEN
  avg(value) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) ELSE value END, 6) AS smooth FROM n""",
)
def moving_average(t):
    out = series.smooth_five(hourly(t), KEY)
    return out.select("series_id", "t", F.round("value", 6).alias("value"), F.round("smooth", 6).alias("smooth"))


DECOMPOSE_SQL = f"""{RAW_PERIOD_SQL},
sized AS (
  SELECT h.series_id, h.t, h.value, coalesce(b.period, 20) AS period, count(*) OVER (PARTITION BY h.series_id) AS n
  FROM hourly h LEFT JOIN best b USING (series_id)),
trended AS (
  SELECT a.series_id, a.t, any_value(a.value) AS value, any_value(a.period) AS period, avg(b.value) AS trend
  FROM sized a JOIN sized b ON a.series_id = b.series_id AND b.t BETWEEN a.t - a.period // 2 AND a.t + a.period // 2
  GROUP BY 1, 2),
phase AS (SELECT series_id, t % period AS ph, avg(value - trend) AS pm FROM trended GROUP BY 1, 2),
season AS (SELECT series_id, ph, pm - avg(pm) OVER (PARTITION BY series_id) AS season FROM phase),
parts AS (
  SELECT t.series_id, t.t, t.value, t.period, t.trend, s.season, t.value - t.trend - s.season AS rest
  FROM trended t JOIN season s ON s.series_id = t.series_id AND s.ph = t.t % t.period)"""


@query(
    "decompose_series",
    f"WITH {DECOMPOSE_SQL} SELECT series_id, t, period, round(trend + 1e-9, 5) AS trend, round(season + 1e-9, 5) AS season, round(rest + 1e-9, 5) AS rest FROM parts",
)
def decompose_series(t):
    out = _parts(hourly(t))
    return out.select("series_id", "t", "period", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("trend", "season", "rest")])


def _parts(base):
    periods = series.best_peak(series.autocorrelation(base, KEY, centred=False), KEY)
    return series.decompose(base, periods, KEY)


ANOMALY_SQL = f"""{HOURLY_SQL},
lagged AS (SELECT series_id, t, value, lag(value) OVER (PARTITION BY series_id ORDER BY t) AS prev FROM hourly),
fit AS (SELECT series_id, regr_slope(value, prev) AS a, regr_intercept(value, prev) AS b FROM lagged GROUP BY 1),
resid AS (SELECT series_id, t, value, value - (b + a * prev) AS resid FROM lagged JOIN fit USING (series_id)),
q AS (SELECT series_id, quantile_cont(resid, 0.25) AS q0, quantile_cont(resid, 0.75) AS q1 FROM resid GROUP BY 1),
flagged AS (
  SELECT series_id, t, value, resid, coalesce(resid < q0 - 3 * (q1 - q0) OR resid > q1 + 3 * (q1 - q0), false) AS is_anomaly
  FROM resid JOIN q USING (series_id)),
marked AS (
  SELECT *, is_anomaly AND NOT coalesce(lag(is_anomaly) OVER (PARTITION BY series_id ORDER BY t), false) AS opens FROM flagged)"""


@query("series_anomalies", f"WITH {ANOMALY_SQL} SELECT series_id, t, round(resid, 5) AS resid, is_anomaly, opens FROM marked")
def series_anomalies(t):
    out = series.autoregressive_anomalies(hourly(t), KEY)
    return out.select("series_id", "t", F.round("resid", 5).alias("resid"), "is_anomaly", "opens")


@query(
    "anomaly_runs",
    f"WITH {ANOMALY_SQL} SELECT series_id, t FROM marked WHERE opens",
)
def anomaly_runs(t):
    return series.autoregressive_anomalies(hourly(t), KEY).where("opens").select("series_id", "t")


@query(
    "series_correlation",
    f"""WITH {HOURLY_SQL}, n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM hourly GROUP BY series_id))
SELECT b.series_id, round(corr(a.value, b.value), 6) AS correlation FROM hourly a JOIN hourly b ON a.t = b.t
WHERE a.series_id = 'click' AND b.series_id <> 'click' AND a.t < (SELECT n FROM n) GROUP BY 1""",
)
def series_correlation(t):
    return series.correlation_with(hourly(t), "click").withColumn("correlation", F.round("correlation", 6))


@query(
    "fluctuation_match",
    f"""WITH {ANOMALY_SQL}, a AS (SELECT series_id, t FROM marked WHERE is_anomaly),
src AS (SELECT t FROM a WHERE series_id = 'click'), oth AS (SELECT * FROM a WHERE series_id <> 'click')
SELECT o.series_id, count(DISTINCT CASE WHEN abs(s.t - o.t) <= 36 THEN s.t END) AS matched,
       round(count(DISTINCT CASE WHEN abs(s.t - o.t) <= 36 THEN s.t END) / greatest((SELECT count(*) FROM src), 1), 6) AS match_ratio
FROM oth o LEFT JOIN src s ON true GROUP BY 1""",
)
def fluctuation_match(t):
    marks = series.autoregressive_anomalies(hourly(t), KEY).where("is_anomaly").select("series_id", "t")
    return series.fluctuation_match(marks, "click", 36).withColumn("match_ratio", F.round("match_ratio", 6))


@query(
    "centred_window",
    f"""WITH {ANOMALY_SQL}, n AS (SELECT series_id, count(*) AS n FROM hourly GROUP BY 1),
c AS (SELECT series_id, t AS centre, least(greatest(0, t - 32), n - 64) AS s FROM marked JOIN n USING (series_id) WHERE opens AND n >= 64)
SELECT c.series_id, centre, h.t - s AS pos, round(h.value, 6) AS value FROM c JOIN hourly h ON h.series_id = c.series_id AND h.t >= s AND h.t < s + 64""",
)
def centred_window(t):
    base = hourly(t)
    centres = series.autoregressive_anomalies(base, KEY).where("opens").select("series_id", F.col("t").alias("centre"))
    return series.centred_window(base, centres, KEY).withColumn("value", F.round("value", 6))


@query("series_slice", f"WITH {HOURLY_SQL} SELECT series_id, t, round(value, 6) AS value FROM hourly WHERE t >= 100 AND t < 300")
def series_slice(t):
    return series.slice_range(hourly(t), 100, 300).withColumn("value", F.round("value", 6))


@query(
    "point_lookup",
    f"WITH {HOURLY_GAPS_SQL} SELECT series_id, t, round(value, 3) AS value FROM gaps WHERE t = 17 OR t BETWEEN 40 AND 49",
)
def point_lookup(t):
    gaps = hourly_gaps(t)
    return gaps.where((F.col("t") == 17) | F.col("t").between(40, 49)).withColumn("value", F.round("value", 3))


@query(
    "trend_segments",
    f"""WITH {DAILY_SQL}, pts AS (
  SELECT series_id, CAST(t // 30 * 30 AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS y FROM daily GROUP BY 1, 2),
step AS (
  SELECT series_id, x, lead(x) OVER w AS nx, lead(y) OVER w - y AS dy,
         max(y) OVER (PARTITION BY series_id) - min(y) OVER (PARTITION BY series_id) AS r
  FROM pts WINDOW w AS (PARTITION BY series_id ORDER BY x)),
named AS (
  SELECT series_id, x, nx, CASE WHEN dy > 0.1 * (CASE WHEN r = 0 THEN 1 ELSE r END) THEN 'increase'
    WHEN dy < -0.1 * (CASE WHEN r = 0 THEN 1 ELSE r END) THEN 'decrease' ELSE 'steady' END AS trend FROM step WHERE nx IS NOT NULL),
heads AS (
  SELECT series_id, x, trend FROM (
    SELECT *, lag(trend) OVER (PARTITION BY series_id ORDER BY x) AS p FROM named) WHERE p IS NULL OR p <> trend)
SELECT series_id, row_number() OVER w - 1 AS segment, trend, x AS start, coalesce(lead(x) OVER w, n - 1) AS "end"
FROM heads JOIN (SELECT series_id, max(t) + 1 AS n FROM daily GROUP BY 1) USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY x)""",
)
def trend_segments(t):
    daily = daily_by_segment(t)
    points = daily.groupBy("series_id", (F.floor(F.col("t") / 30) * 30).cast("bigint").alias("x")).agg(F.count("*").cast("double").alias("y"))
    lengths = daily.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    return series.trend_segments(points.join(lengths, "series_id"), KEY, "n")


REPORT_ROUND = ("trend_start", "trend_change", "max_season", "min_season", "rest_std")


@query(
    "series_report",
    f"""WITH {DECOMPOSE_SQL},
src AS (SELECT t, trend FROM parts WHERE series_id = 'click'),
c AS (SELECT p.series_id, corr(s.trend, p.trend) AS r FROM parts p JOIN src s USING (t) GROUP BY 1),
g AS (
  SELECT series_id, any_value(period) AS period, min_by(trend, t) AS a, max_by(trend, t) AS b, max(season) AS hi, min(season) AS lo,
         stddev_pop(rest) AS sd FROM parts GROUP BY 1)
SELECT series_id, period, round(a, 2) AS trend_start, round(b - a, 2) AS trend_change, round(hi, 2) AS max_season, round(lo, 2) AS min_season,
       round(sd, 3) AS rest_std, round(r, 3) AS trend_correlation, r > 0.7 AS similar_trend FROM g JOIN c USING (series_id)""",
)
def series_report(t):
    parts = _parts(hourly(t))
    first, last = F.min_by("trend", "t"), F.max_by("trend", "t")
    shape = parts.groupBy("series_id").agg(
        F.first("period").alias("period"),
        F.round(first, 2).alias("trend_start"),
        F.round(last - first, 2).alias("trend_change"),
        F.round(F.max("season"), 2).alias("max_season"),
        F.round(F.min("season"), 2).alias("min_season"),
        F.round(F.stddev_pop("rest"), 3).alias("rest_std"),
    )
    source = parts.where("series_id = 'click'").select("t", F.col("trend").alias("_s"))
    likeness = parts.join(source, "t").groupBy("series_id").agg(F.corr("_s", "trend").alias("_r"))
    joined = shape.join(likeness, "series_id")
    return joined.withColumn("trend_correlation", F.round("_r", 3)).withColumn("similar_trend", F.col("_r") > 0.7).drop("_r")


@query(
    "labelled_windows",
    f"""WITH {HOURLY_SQL},
e AS (SELECT series_id, 0 AS change_no, 'high' AS label, min_by(t, (-value, t)) AS c, count(*) AS n FROM hourly GROUP BY 1 UNION ALL SELECT series_id, 1, 'low', min_by(t, (value, t)), count(*) FROM hourly GROUP BY 1),
w AS (SELECT *, least(greatest(0, (c + c + 5) // 2 - 16), n - 32) AS s FROM e)
SELECT w.series_id, change_no, label, list(round(value, 6) ORDER BY t) AS x FROM w JOIN hourly h ON h.series_id = w.series_id AND h.t >= s AND h.t < s + 32 GROUP BY 1, 2, 3""",
)
def labelled_windows(t):
    rows = hourly(t)
    ends = rows.groupBy("series_id").agg(F.min_by("t", F.struct(-F.col("value"), F.col("t"))).alias("hi"), F.min_by("t", F.struct("value", "t")).alias("lo"))
    at = lambda no, name, c: F.struct(F.lit(no).alias("change_no"), F.lit(name).alias("label"), F.col(c).alias("start"), (F.col(c) + 5).alias("end"))
    changes = ends.select("series_id", F.explode(F.array(at(0, "high", "hi"), at(1, "low", "lo"))).alias("c")).select("series_id", "c.*")
    out = series.labelled_windows(rows, changes, KEY, "label", 32)
    return out.withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
