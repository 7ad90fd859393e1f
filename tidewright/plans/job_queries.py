"""Whole jobs over the given tables; model replies are worded from table text."""

from pyspark.sql import functions as F

from tidewright.operators import jobs
from tidewright.plans.inputs import hourly_gaps
from tidewright.plans.interval_queries import INTERVAL_SQL, RUN_SQL, label_ranges, motion
from tidewright.plans.registry import query
from tidewright.plans.routine_queries import ACTION, CLOCK, LINE, OBJECTS, RAW_SQL, ROOM, raw
from tidewright.plans.similarity_queries import TOKENS
from tidewright.session import shared_path

LEVELS = ["very poor", "poor", "average", "good", "excellent"]


@query(
    "tag_and_filter",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT vec_id, ['very poor', 'poor', 'average', 'good', 'excellent'][CAST(doc.n_chars % 5 + 1 AS INT)] AS input_quality, CAST(doc.n_chars % 3 + 3 AS VARCHAR) AS judge_quality_score,
  CASE WHEN doc.source = 'src3' THEN 'hard' ELSE 'easy' END AS difficulty FROM v JOIN documents doc ON doc.doc_id = vec_id),
p AS (SELECT a.vec_id AS i, min(b.vec_id) AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND pow(list_distance(a.e, b.e), 2) < 0.8
  WHERE a.vec_id IN (SELECT vec_id FROM r) AND b.vec_id IN (SELECT vec_id FROM r) GROUP BY 1)
SELECT vec_id, input_quality, judge_quality_score, difficulty, CASE WHEN j IS NOT NULL THEN least(i, j) END AS min_similar_id,
  CASE WHEN input_quality NOT IN ('good', 'excellent') THEN 'input quality' WHEN judge_quality_score <> '5' THEN 'judge quality'
    WHEN difficulty NOT IN ('easy', 'medium') THEN 'difficulty' WHEN j IS NOT NULL AND vec_id <> least(i, j) THEN 'duplicate' END AS reason
FROM r LEFT JOIN p ON i = vec_id""",
)
def tag_and_filter(t):
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), (F.col("n_chars") % 5).cast("int"))
    said = {
        "quality": F.concat(F.lit('{"explanation": "as read", "input_quality": "'), level, F.lit('"}')),
        "sample_quality": F.concat(F.lit('```json\n{"score": "'), (F.col("n_chars") % 3 + 3).cast("string"), F.lit('"}\n```')),
        "difficulty": F.concat(F.lit('I think "difficulty": "'), F.when(F.col("source") == "src3", "hard").otherwise("easy"), F.lit('" {')),
    }
    rows = t.embeddings.select("vec_id", "embedding").join(t.documents.withColumnRenamed("doc_id", "vec_id"), "vec_id")
    rows = rows.select("vec_id", "embedding", *[c.alias(f"said_{k}") for k, c in said.items()])
    out = jobs.tag_and_filter(rows, "vec_id", "embedding", {k: f"said_{k}" for k in said}, 0.8, "high_quality_filter", difficulty=("easy", "medium"))
    return out.select("vec_id", "input_quality", "judge_quality_score", "difficulty", "min_similar_id", "reason")


@query(
    "knowledge_pairs",
    r"""WITH w AS (SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT *, CASE WHEN len(w) <= 200 THEN 1 WHEN len(w) % 200 > 60 THEN len(w) // 200 + 1 ELSE greatest(len(w) // 200, 1) END AS k FROM w),
e AS (SELECT doc_id, unnest(range(0, k)) AS chunk_no, w, k FROM m),
c AS (SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, w[chunk_no * 200 + 1 : CASE WHEN chunk_no = k - 1 THEN len(w) ELSE chunk_no * 200 + 200 END] AS p FROM e),
q AS (SELECT doc_id, chunk_no, 0 AS pair_no, 'What of ' || p[1] || '?' AS question, p[2] AS answer, len(p) AS n FROM c WHERE len(p) >= 2
  UNION ALL SELECT doc_id, chunk_no, 1, 'And ' || p[3] || '?', p[4], len(p) FROM c WHERE len(p) >= 4 AND len(p) % 3 <> 0)
SELECT doc_id, chunk_no, pair_no, question, answer, CASE WHEN strlen(answer) % 4 = 0 THEN 'faithful' WHEN strlen(question) % 5 = 0 THEN 'relevant' WHEN n % 7 = 0 THEN 'verified' END AS reason FROM q""",
)
def knowledge_pairs(t):
    # The reply parser takes opening brackets as its marks, so the words a reply quotes have theirs escaped.
    def escaped(c):
        return F.replace(F.replace(c, F.lit("\ue000"), F.lit("\ue000e")), F.lit("["), F.lit("\ue000b"))

    def plain(c):
        return F.replace(F.replace(F.col(c), F.lit("\ue000b"), F.lit("[")), F.lit("\ue000e"), F.lit("\ue000"))

    def answer(chunks):
        p = F.filter(F.split(escaped(F.col("content")), " "), lambda w: w != "")
        first = F.concat(F.lit("What of "), F.get(p, F.lit(0)), F.lit("?\n[Answer]\n"), F.get(p, F.lit(1)), F.lit("\n[End]\n"))
        second = F.concat(F.lit("[Question]\nAnd "), F.get(p, F.lit(2)), F.lit("?\n[Answer]\n"), F.get(p, F.lit(3)), F.when(F.size(p) % 3 == 0, F.lit("")).otherwise(F.lit("\n[End]")))
        reply = F.when(F.size(p) >= 4, F.concat(first, second)).when(F.size(p) >= 2, first).otherwise("nothing to ask")
        return chunks.withColumn("n", F.size(p)).withColumn("reply", reply)

    def judge(pairs, rule):
        if rule == "faithful":
            return F.when(F.octet_length(plain("answer")) % 4 == 0, "**Answer:** NO").otherwise("**Answer:** YES")
        if rule == "relevant":
            return F.when(F.octet_length(plain("question")) % 5 == 0, "Total Score: 1/2").otherwise("Total Score: 2/2")
        return F.when(F.col("n") % 7 == 0, "Rating: 0").otherwise("Rating: 1")

    out = jobs.knowledge_pairs(t.documents.select("doc_id", "text"), "text", 200, 60, answer, judge)
    return out.select("doc_id", "chunk_no", "pair_no", plain("question").alias("question"), plain("answer").alias("answer"), "reason")


@query(
    "skill_pairs",
    """WITH r AS (SELECT o_orderkey, o_orderstatus <> 'F' AS has_context, o_orderpriority AS p, o_custkey AS c FROM orders),
q AS (SELECT o_orderkey, has_context, c, unnest(CASE WHEN has_context THEN [0, 1, 2] ELSE [0] END) AS question_no, p FROM r),
s AS (SELECT o_orderkey, has_context, question_no, c, CASE WHEN has_context THEN 'Why ' || p || ' ' || CAST(question_no AS VARCHAR) ELSE 'Tell ' || p END AS question FROM q),
g AS (SELECT *, (c + question_no) % 3 <> 0 AS fine FROM s)
SELECT o_orderkey, question_no, question, CASE WHEN fine THEN 'It is ' || question END AS answer,
  CASE WHEN NOT fine THEN 'question' WHEN (c + question_no) % 4 IN (0, 1) THEN 'answer' END AS reason FROM g""",
)
def skill_pairs(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("context"))

    def ask(df):
        block = lambda i: F.concat(F.lit(f"### Question {i + 1}:\nWhy "), F.col("o_orderpriority"), F.lit(f" {i}\n"))
        return df.withColumn("reply", F.when(F.col("context").isNotNull(), F.concat(*[block(i) for i in range(3)])).otherwise(F.concat(F.lit(" Tell "), "o_orderpriority")))

    rating = F.col("o_custkey") + F.col("question_no")
    good = lambda df: F.when(rating % 3 == 0, "Rating: [[0]]").otherwise("Rating: [[1]]")
    fine = lambda df: F.concat(F.lit("Rating: [["), (rating % 4).cast("string"), F.lit("]]"))
    out = jobs.skill_pairs(rows, ask, good, lambda df: F.concat(F.lit("It is "), "question"), fine)
    return out.select("o_orderkey", "question_no", "question", "answer", "reason")


@query(
    "instruction_batch",
    rf"""WITH p AS (SELECT conv_id * 4294967296 + turn AS id, text, regexp_replace(split_part(text, chr(10), 1), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS i FROM conversations),
n AS (SELECT *, len(list_filter(string_split_regex(i, '\s+'), lambda x: x <> '')) AS words FROM p),
f AS (SELECT id, i, CASE WHEN words <= 3 OR words > 150 THEN 'words'
    WHEN regexp_matches(i, '(?i)\b(image|images|graph|graphs|picture|pictures|file|files|map|maps|draw|plot|go to|video|audio|music|flowchart|diagram)\b') THEN 'denied word'
    WHEN starts_with(i, 'Write a program') THEN 'program' WHEN regexp_matches(i, '^[[:punct:]]') THEN 'punctuation' WHEN unicode(i) > 127 THEN 'non-ascii' END AS reason FROM n),
d AS (SELECT id, list_distinct({TOKENS.format(c='i')}) AS w FROM f WHERE reason IS NULL),
s AS (SELECT DISTINCT a.id FROM d a JOIN d b ON b.id < a.id AND len(a.w) > 0 AND len(b.w) > 0 AND 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) >= 0.8)
SELECT f.id, i AS instruction, coalesce(reason, CASE WHEN s.id IS NOT NULL THEN 'similar' END) AS reason FROM f LEFT JOIN s ON s.id = f.id""",
)
def instruction_batch(t):
    head = F.substring_index("text", "\n", 1)
    said = F.concat(F.lit(" ** Instruction: "), head, F.lit("\n** Input\n<noinput>\n** Output: "), head)
    replies = t.conversations.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("id"), said.alias("response"))
    return jobs.instruction_batch(replies, "id", "response", 0.8, filter_invalids=False).select("id", "instruction", "reason")


@query(
    "routine_job",
    f"""WITH {RAW_SQL}, l AS (SELECT *, k % 5 = 0 AS head, lower(replace({ROOM}, ' ', '')) AS r, {CLOCK} AS c FROM raw WHERE k % 5 = 0 OR k % 17 <> 0),
s AS (SELECT file, line_no, k, event_type, head, c, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER w AS block_no, last_value(CASE WHEN head THEN r END IGNORE NULLS) OVER w AS room,
  last_value(CASE WHEN head THEN event_type END IGNORE NULLS) OVER w AS activity FROM l WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, CASE WHEN head THEN '[walk] <' || room || '> (' || c || ' - ' || c || ') (' || room || ')' ELSE '[' || {ACTION} || ']' || {OBJECTS} || ' (' || c || ' - ' || c || ') (' || coalesce(room, 'None') || ')' END AS text FROM s),
g AS (SELECT *, CASE WHEN contains(text, 'dance') THEN '[]' ELSE text END AS ground FROM p),
f AS (SELECT *, ground = '[]' OR contains(ground, '<>') OR (NOT head AND k % 7 = 2 AND k % 3 = 0) AS broken FROM g)
SELECT file, CAST(block_no AS BIGINT) AS block_no, line_no, CASE WHEN broken THEN '[open] <door> (' || c || ' - ' || c || ')' ELSE ground END AS text, upper(activity) AS label FROM f WHERE file NOT IN (SELECT file FROM f WHERE block_no = 0)""",
)
def routine_job(t):
    def ground(steps):
        return steps.withColumn("text", F.when(F.contains("text", F.lit("dance")), "[]").otherwise(F.col("text")))

    lines = raw(t).select("file", "line_no", F.expr(LINE).alias("text"))
    clock = raw(t).select("file", "line_no", F.expr(CLOCK).alias("c"))
    parsed = jobs.routine.parse_routine(lines, 500).select("file", "block_no", "line_no").join(clock, ["file", "line_no"])
    fixes = parsed.select("file", "block_no", "line_no", F.format_string("[open] <door> (%s - %s)", "c", "c").alias("text"))
    labels = t.events.select(F.col("event_type").alias("activity")).distinct().withColumn("label", F.upper("activity"))
    steps, _, _ = jobs.routine_job(lines, ground, fixes, labels, chunk_lines=500)
    return steps.select("file", "block_no", "line_no", "text", "label")


@query(
    "sensor_job",
    f"""WITH {RUN_SQL}, on_rows AS (SELECT DISTINCT room, sensor, frame FROM motion WHERE sqrt(x * x + y * y + z * z) > 0),
gaps AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY room, sensor ORDER BY frame) < 20 THEN 0 ELSE 1 END AS opens FROM on_rows),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY room, sensor ORDER BY frame) AS no FROM gaps),
spans AS (SELECT room, sensor, no, min(frame) AS start, max(frame) AS last FROM numbered GROUP BY 1, 2, 3),
tr AS (SELECT room, sensor, start AS frame, 'ON' AS state FROM spans UNION ALL SELECT room, sensor, last + 1, 'OFF' FROM spans),
placed AS (SELECT m.room, m.run_id, m.label, tr.frame, tr.sensor, tr.state FROM tr JOIN merged m ON m.room = tr.room AND tr.frame >= m.start AND tr.frame <= m."end")
SELECT room, run_id, label, list(frame ORDER BY frame, sensor, state) AS times, list(sensor ORDER BY frame, sensor, state) AS sensors, list(state ORDER BY frame, sensor, state) AS states
FROM placed GROUP BY 1, 2, 3 HAVING count(*) > 2""",
)
def sensor_job(t):
    return jobs.sensor_job(motion(t), label_ranges(t), "room", width=200)


@query("synthesised_series")
def synthesised_series(t):
    """The model's place is taken by given rows with every score moved by up to five hundredths of its own size."""

    def make_batch(number, rows):
        moved = F.transform("z", lambda v, i: v * (1 + 0.01 * (F.pmod(F.xxhash64(F.lit(number), F.col("id"), i), F.lit(11)) - 5)))
        return rows.select((F.col("id") + 1_000_000 * (number + 1)).alias("id"), moved.alias("z"))

    out = jobs.series_synthesis(hourly_gaps(t), "series_id", shared_path(t.spark), make_batch, 20, min_points=48, threshold=2.0)  # enough rows end it
    return out.select("channel", "round", "id", F.transform("x", lambda v: F.round(v, 3)).alias("x"))
