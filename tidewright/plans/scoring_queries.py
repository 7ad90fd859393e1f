"""Answer scoring queries; answers are worded from order and line numbers, so the true values are known."""

from pyspark.sql import functions as F

from tidewright.functions import scoring
from tidewright.operators import evaluation
from tidewright.plans.registry import query

CLOSE = "CASE WHEN abs({t}) < 0.5 THEN CASE WHEN abs({s}) < 0.5 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, 1.0 - abs({s} - {t}) / abs({t}))) END"


def lines(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (F.col("l_discount") * 100).alias("disc"), (F.col("l_tax") * 100).alias("tax"), "l_returnflag")


@query(
    "trend_scores",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS DOUBLE) AS categorical, round(CAST({CLOSE.format(s='round(l_tax * 100, 2)', t='l_discount * 100')} AS DOUBLE), 6) AS start_score,
  round(CAST(CASE WHEN l_returnflag = 'N' THEN NULL ELSE {CLOSE.format(s='l_quantity', t='(l_quantity + 3)')} END AS DOUBLE), 6) AS change_score FROM lineitem""",
)
def trend_scores(t):
    kind = F.when(F.col("l_returnflag") == "A", "increase").when(F.col("l_returnflag") == "N", "keep steady").otherwise("decrease")
    said = F.when(F.col("l_returnflag") == "A", "The trend is Increasing").when(F.col("l_returnflag") == "N", "The trend is steady").otherwise("It rises")
    answer = F.concat(said, F.lit(", it starts around "), F.round("tax", 2).cast("string"), F.lit(", the change value is "), F.col("l_quantity").cast("string"), F.lit("."))
    score = scoring.trend(answer, kind, F.col("disc"), F.col("l_quantity") + 3)
    scored = lines(t).withColumn("s", score)
    score = F.col("s")
    return scored.select(
        "l_orderkey", "l_linenumber", "l_partkey", score["categorical"][0].alias("categorical"),
        F.round(score["numerical"][0], 6).alias("start_score"), F.round(F.get(score["numerical"], F.lit(1)), 6).alias("change_score"),
    )


@query(
    "season_noise_scores",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 1.0::DOUBLE AS season, round({CLOSE.format(s='l_quantity', t='(l_quantity + 2)')}, 6) AS period_score,
  CAST(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS DOUBLE) AS noise, round({CLOSE.format(s='round(l_tax * 100, 2)', t='(l_discount * 100 + 1)')}, 6) AS std_score FROM lineitem""",
)
def season_noise_scores(t):
    season = F.concat(F.lit("A periodic wave; each period is about "), F.col("l_quantity").cast("string"), F.lit(" points."))
    noisy = F.when(F.col("l_returnflag") == "A", "It is Noisy").otherwise("It is calm")
    noise = F.concat(noisy, F.lit(", with a Standard deviation of "), F.round("tax", 2).cast("string"), F.lit("."))
    s = scoring.season(season, F.lit("sin periodic fluctuation"), F.col("l_quantity") + 2, F.lit(1.0))
    n = scoring.noise(noise, F.lit("noisy"), F.col("disc") + 1)
    scored = lines(t).withColumns({"s": s, "n": n})
    s, n = F.col("s"), F.col("n")
    return scored.select(
        "l_orderkey", "l_linenumber", "l_partkey", s["categorical"][0].alias("season"), F.round(s["numerical"][0], 6).alias("period_score"),
        n["categorical"][0].alias("noise"), F.round(n["numerical"][0], 6).alias("std_score"),
    )


@query(
    "local_change_scores",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity <= 40 AS DOUBLE) AS found, round(CASE WHEN l_quantity <= 40 THEN {CLOSE.format(s='(l_quantity + 100)', t='(l_quantity * 2 + 124)')} ELSE 0 END, 6) AS position,
  round(CASE WHEN l_quantity <= 40 THEN {CLOSE.format(s='l_quantity', t='(l_quantity + 1)')} ELSE 0 END, 6) AS amplitude, 0.0::DOUBLE AS missed FROM lineitem""",
)
def local_change_scores(t):
    q = F.col("l_quantity")
    answer = F.concat(F.lit("A shake, around point 3, small; An upward spike, at position "), (q + 100).cast("int").cast("string"), F.lit(", with an amplitude of "), q.cast("int").cast("string"), F.lit(", due to load"))
    feature = lambda name, p, a: F.struct(F.array(F.lit(name)).alias("types"), p.alias("position"), a.alias("amplitude"))
    features = F.array(feature("upward spike", q * 2 + 124, q + 1), feature("downward spike", q, q))
    s = scoring.local_explained(answer, features, F.array(F.lit(0.5), F.lit(0.5)))
    scored = lines(t).withColumn("s", s)
    s = F.col("s")
    return scored.select(
        "l_orderkey", "l_linenumber", "l_partkey", s["categorical"][0].alias("found"), F.round(s["numerical"][0], 6).alias("position"),
        F.round(s["numerical"][1], 6).alias("amplitude"), s["categorical"][1].alias("missed"),
    )


@query(
    "choice_scores",
    """SELECT o_orderkey, CAST(o_orderstatus <> 'P' AS DOUBLE) AS deductive, CAST(o_orderstatus = 'F' AS DOUBLE) AS causal, CAST(o_orderstatus = 'O' AS DOUBLE) AS multiple,
  CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 0 END AS DOUBLE) AS pairs, CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.0 END AS DOUBLE) AS cluster FROM orders""",
)
def choice_scores(t):
    by = lambda f, o, p: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", o).otherwise(p)
    cols = F.array(*[F.lit(c) for c in ("cpu load", "memory", "disk")])
    pair = lambda m, d: F.struct(F.lit(m).alias("metric"), F.lit(d).alias("detail"))
    deductive = scoring.deductive(by("Yes, it is.", "YES. it holds", "No."), F.lit("yes, as shown"), F.lit(None).cast("double"))
    causal = scoring.causal(by("Option-A, because.", "B.", ""), F.lit("option a."))
    multiple = scoring.multiple_choice(by("first", "(C) third one", "x"), F.lit("third"))
    pairs = scoring.local_correlation(
        by("Yes. CPU-load, upward spike; memory, shake. Why", "Yes. memory, shake. Why", ""), F.lit(True), F.array(pair("cpu load", "upward spike"), pair("memory", "shake")), cols, F.lit(0.0)
    )
    cluster = scoring.shape_cluster(by("cpu load, memory. Since", "cpu load, disk, memory. Since", ""), F.array(F.lit("memory"), F.lit("cpu load")), cols, F.lit(1.0))
    return t.orders.select(
        "o_orderkey", deductive["reason"][0].alias("deductive"), causal["reason"][0].alias("causal"), multiple["reason"][0].alias("multiple"),
        pairs["categorical"][0].alias("pairs"), F.round(cluster["categorical"][0], 6).alias("cluster"),
    )


@query(
    "score_report",
    f"""WITH a AS (SELECT o_orderkey AS idx, max_by(l_tax * 100, (l_linenumber, l_partkey, l_tax, l_quantity)) AS said, max_by(l_quantity, (l_linenumber, l_partkey, l_tax, l_quantity)) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT o_orderkey, o_custkey % 10 + 1 AS truth, said, q FROM orders LEFT JOIN a ON idx = o_orderkey),
v AS (SELECT 'trend' AS ability, 'categorical' AS kind, CAST(said IS NOT NULL AS DOUBLE) AS v FROM s
  UNION ALL SELECT 'trend', 'numerical', CASE WHEN said IS NULL THEN 0 ELSE {CLOSE.format(s='round(said, 2)', t='truth')} END FROM s
  UNION ALL SELECT 'noise', 'categorical', CAST(said IS NOT NULL AS DOUBLE) FROM s
  UNION ALL SELECT 'noise', 'numerical', CASE WHEN said IS NULL THEN 0 ELSE {CLOSE.format(s='q', t='truth')} END FROM s)
SELECT kind, ability, round(avg(v), 4) AS mean, count(*) AS n FROM v GROUP BY GROUPING SETS ((kind, ability), (kind))""",
)
def score_report(t):
    samples = t.orders.select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 10 + 1).cast("double").alias("truth"), F.array(F.lit("trend"), F.lit("noise")).alias("abilities"))
    said = F.concat(F.lit("1. The trend is steady, it starts at "), F.round(F.col("l_tax") * 100, 2).cast("string"), F.lit(".\n2. It is noisy, the std is "), F.col("l_quantity").cast("string"), F.lit("."))
    answers = t.lineitem.select(F.col("l_orderkey").alias("idx"), F.struct("l_linenumber", "l_partkey", "l_tax", "l_quantity").alias("part_no"), said.alias("response"))
    rows = evaluation.answer_rows(samples, answers)
    trend = scoring.trend("answer", F.lit("keep steady"), "truth", F.lit(0.0))
    noise = scoring.noise("answer", F.lit("noisy"), "truth")
    return evaluation.score_report(rows.select("ability", F.when(F.col("ability") == "trend", trend).otherwise(noise).alias("score")))


@query("token_total", "SELECT CAST(sum(coalesce(CASE WHEN l_linenumber > 1 THEN l_suppkey END, 0)) AS BIGINT) AS consumed_tokens FROM lineitem")
def token_total(t):
    return evaluation.token_total(t.lineitem.select(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("num_tokens")))
