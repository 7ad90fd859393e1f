"""Question, pair-label and sample-check queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import questions, synthesis
from tidewright.plans.registry import query
from tidewright.plans.synthesis_queries import ids, systems
from tidewright.session import durable


@query(
    "statistic_texts",
    """SELECT c_mktsegment, 'In ' || c_mktsegment || ', the mean value is ' || CAST(count(*) AS VARCHAR) || ', the minimum value is ' || CAST(min(c_nationkey) AS VARCHAR) || ' (around point ' || CAST(min(c_custkey) AS VARCHAR)
  || '), and the maximum value is ' || CAST(max(c_nationkey) AS VARCHAR) || ' (around point ' || CAST(max(c_custkey) AS VARCHAR) || ');' AS line FROM customer GROUP BY 1""",
)
def statistic_texts(t):
    rows = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("m"), F.min("c_nationkey").alias("lo"), F.min("c_custkey").alias("lp"), F.max("c_nationkey").alias("hi"), F.max("c_custkey").alias("hp"))
    return rows.select("c_mktsegment", questions.statistic_text("c_mktsegment", "m", "lo", "lp", "hi", "hp").alias("line"))


def made(t):
    return synthesis.synthesise(synthesis.random_attributes(ids(t), seed=3), seed=3)


def system_series(t):
    """One synthetic series per customer; the customers of a nation and segment are systems of at most seven."""
    place = Window.partitionBy("n", "metric").orderBy("series_id")
    rows = ids(t).join(t.customer.select(F.col("c_custkey").alias("series_id"), F.col("c_nationkey").alias("n")), "series_id")
    rows = rows.withColumn("seq_len", F.lit(96)).withColumn("_p", F.row_number().over(place) - 1)
    system = F.concat_ws(" ", F.col("n").cast("string"), "metric", F.floor(F.col("_p") / 7).cast("string"))
    named = rows.select("series_id", "seq_len", system.alias("system"), (F.col("_p") % 7).alias("series_no"), F.concat(F.lit("load "), (F.col("_p") % 7).cast("string")).alias("metric"))
    return synthesis.synthesise(synthesis.random_attributes(named, seed=8), seed=8)


@query("series_questions")
def series_questions(t):
    return questions.series_questions(made(t), seed=3)


@query("explained_questions")
def explained_questions(t):
    return questions.series_questions(made(t), seed=4, explain=True)


@query("series_captions")
def series_captions(t):
    return questions.captions(made(t))


@query("system_questions")
def system_questions(t):
    return questions.system_questions(system_series(t), seed=5)


@query("field_contexts")
def field_contexts(t):
    rows = durable(system_series(t))
    asked = questions.system_questions(rows, seed=5)
    pool = asked.where("kind LIKE 'same%'").select("system", F.col("fields")["correlation"][0].alias("group_no"), "answer")
    wanted = asked.select("system", F.explode("fields").alias("field", "numbers")).groupBy("system", "field").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    more = rows.groupBy("system").agg(F.collect_list(F.col("series_no").cast("int")).alias("numbers")).select("system", F.lit("statistic").alias("field"), "numbers")
    return questions.field_contexts(wanted.unionByName(more), rows, pool)


@query(
    "similar_fluctuations",
    """WITH RECURSIVE m AS (SELECT o_custkey AS system, l_orderkey AS metric_id, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY metric_id) AS k FROM m),
r AS (SELECT system, k, metric_id, metric_id AS representative, [{'id': metric_id, 'p': p}] AS reps FROM k WHERE k = 1
  UNION ALL SELECT system, k, metric_id, coalesce(f[1].id, metric_id), CASE WHEN len(f) = 0 THEN list_append(reps, {'id': metric_id, 'p': p}) ELSE reps END
  FROM (SELECT k.system, k.k, k.metric_id, k.p, r.reps, list_filter(r.reps, lambda x: len(x.p) = len(k.p) AND len(list_filter(list_zip(x.p, k.p), lambda z: abs(z[1] - z[2]) > 15)) = 0) AS f
    FROM r JOIN k ON k.system = r.system AND k.k = r.k + 1))
SELECT system, representative, metric_id FROM r""",
)
def similar_fluctuations(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("r"))
    owners = t.orders.groupBy(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").agg(F.count("*").cast("int").alias("m"))  # an order may repeat
    every = F.when(F.col("m") > 1, F.flatten(F.array_repeat("r", F.col("m")))).otherwise(F.col("r"))
    rows = lines.join(owners, "l_orderkey").select(F.col("o_custkey").alias("system"), F.col("l_orderkey").alias("metric_id"), F.array_sort(every).alias("r"))
    return questions.similar_groups(rows.select("system", "metric_id", F.col("r.l_quantity").alias("positions")))


def grouped_series(t):
    """(series, positions, pairs) of systems whose groups change at common places."""
    members = durable(synthesis.shared_positions(synthesis.metric_groups(systems(t), seed=2), 256, seed=2))
    attrs = synthesis.random_attributes(members.withColumn("seq_len", F.lit(256)), seed=4, id="metric_id")
    kinds = F.when(F.size("change_positions") > 0, F.array(F.coalesce(F.get("change_types", F.lit(0)), F.lit("upward spike")))).otherwise(F.array().cast("array<string>"))
    rows = durable(synthesis.synthesise(attrs.withColumn("change_types", kinds), seed=4, id="metric_id"))
    points = members.where("group_no IS NOT NULL").groupBy("system", "group_no").agg(F.first("group_position").alias("point"))
    return rows, points, questions.labelled_pairs(members, seed=2)


@query("pair_questions")
def pair_questions(t):
    rows, points, pairs = grouped_series(t)
    return questions.pair_questions(pairs, rows, points)


@query("cluster_questions")
def cluster_questions(t):
    rows, points, _ = grouped_series(t)
    return questions.cluster_questions(rows, points)


@query("rewritten_questions")
def rewritten_questions(t):
    asked = questions.series_questions(made(t), seed=3).where("kind = 'shape'").select(F.col("series_id").alias("sample_id"), "question", "answer")
    ask = lambda df: df.withColumns({"new_question": F.concat("kind", F.lit(": "), "question"), "new_answer": F.when(F.col("sample_id") % 7 != 0, F.col("answer"))})
    judge = lambda df: F.when((F.col("sample_id") + F.size("path")) % 3 == 0, "This is invalid.").otherwise("Valid")
    return questions.rewrite(asked, ask, judge, rounds=2, children=2, seed=1)


@query("labelled_pairs")
def labelled_pairs(t):
    return questions.labelled_pairs(synthesis.metric_groups(systems(t), seed=2), seed=2)


@query("numbered_sets")
def numbered_sets(t):
    qs = F.collect_list(F.struct(F.concat(F.lit("What is line "), F.col("l_linenumber").cast("string"), F.lit("?")).alias("question"), F.col("l_returnflag").alias("answer")))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(qs).alias("qs"))
    return questions.numbered_set(rows, "l_orderkey", "qs", seed=1)


@query(
    "checked_replies",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing field' WHEN o_orderstatus <> 'F' THEN 'not passed' END AS reason FROM orders",
)
def checked_replies(t):
    said = F.when(F.col("o_orderstatus") == "F", "It PASSES").when(F.col("o_orderstatus") == "O", "pass? no, fail").otherwise("unsure")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("question"), said.alias("check"))
    return questions.checked(rows, "check", ["question"]).select("o_orderkey", "reason")
