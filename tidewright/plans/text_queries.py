"""Text queries over documents, conversations and columns worded as model responses."""

from pyspark.sql import functions as F

from tidewright.functions import encoding, tags, text
from tidewright.plans.registry import query
from tidewright.session import spread_out

NL = "chr(10)"


@query(
    "chunk_documents",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, len(w) AS total, len(w) // 200 AS fullc, len(w) % 200 AS rest FROM w),
m AS (SELECT *, CASE WHEN total <= 200 THEN 1 WHEN rest > 60 THEN fullc + 1 ELSE greatest(fullc, 1) END AS k FROM n),
e AS (SELECT *, unnest(range(0, k)) AS chunk_no FROM m),
p AS (SELECT doc_id, chunk_no, w[chunk_no * 200 + 1 : CASE WHEN chunk_no = k - 1 THEN total ELSE chunk_no * 200 + 200 END] AS piece FROM e)
SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, coalesce(array_to_string(piece, ' '), '') AS content, CAST(len(piece) AS INT) AS document_len FROM p""",
)
def chunk_documents(t):
    return text.chunk_words(t.documents.select("doc_id", "text"), "text", 200, 60)


@query(
    "without_references",
    """WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN 'References' || coalesce(source, '') ELSE '' END AS cited FROM documents)
SELECT doc_id, CASE WHEN strpos(cited, 'References') > 0 THEN left(cited, strpos(cited, 'References') - 1) ELSE cited END AS cut FROM d""",
)
def without_references(t):
    cited = F.concat("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("References"), F.coalesce("source", F.lit("")))).otherwise(""))
    return t.documents.select("doc_id", text.without_references(cited).alias("cut"))


@query(
    "sentence_counts",
    r"""WITH g AS (SELECT doc_id, regexp_replace(text, '(max|eg|Mrs|Dr|Mr)\.', '\1', 'g') AS t FROM documents),
p AS (SELECT doc_id, regexp_replace(t, '[.!?。！？,;，；](\d)', '\1', 'g') AS t FROM g)
SELECT doc_id, CAST(len(list_filter(string_split_regex(t, '[.!?。！？,;，；]'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS INT) AS n_sentences FROM p""",
)
def sentence_counts(t):
    return t.documents.select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


@query(
    "period_sentences",
    r"""WITH g AS (SELECT conv_id, turn, regexp_replace(text, '(max|eg|Mrs|Dr|Mr)\.', '\1', 'g') AS t FROM conversations),
p AS (SELECT conv_id, turn, regexp_replace(t, '[.。](\d)', '\1', 'g') AS t FROM g)
SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(t, '[.。]'), lambda x: regexp_replace(x, '\s+', '', 'g') <> '')) AS INT) AS n_sentences FROM p""",
)
def period_sentences(t):
    return t.conversations.select("conv_id", "turn", F.size(text.period_sentences("text")).alias("n_sentences"))


@query(
    "metric_mentions",
    """SELECT p_partkey, contains(lower(regexp_replace(p_type || ' ' || p_name, '[^a-zA-Z]', '', 'g')), lower(regexp_replace(split_part(p_name, ' ', 2), '[^a-zA-Z]', '', 'g'))) AS by_name,
  contains(lower(regexp_replace(p_type, '[^a-zA-Z]', '', 'g')), lower(regexp_replace(p_brand, '[^a-zA-Z]', '', 'g'))) AS by_brand FROM part""",
)
def metric_mentions(t):
    return t.part.select(
        "p_partkey",
        text.names_metric(F.split("p_name", " ")[1], F.concat_ws(" ", "p_type", "p_name")).alias("by_name"),
        text.names_metric("p_brand", "p_type").alias("by_brand"),
    )


@query(
    "relative_scores",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_discount * 10) < 0.5 THEN CASE WHEN abs(l_tax * 10) < 0.5 THEN 1.0 ELSE 0.0 END
  ELSE greatest(0.0, least(1.0, 1.0 - abs(l_tax * 10 - l_discount * 10) / abs(l_discount * 10))) END, 6) AS score FROM lineitem""",
)
def relative_scores(t):
    score = text.relative_score(F.col("l_tax") * 10, F.col("l_discount") * 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(
    "numbered_answers",
    f"""WITH a AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN replace(replace(text, {NL}, ' '), chr(13), ' ') END) AS u, max(CASE WHEN turn = 1 THEN replace(replace(text, {NL}, ' '), chr(13), ' ') END) AS v FROM conversations GROUP BY 1)
SELECT conv_id, 'a' || coalesce(u, '') AS first, 'b' || coalesce(v, '') AS second, '' AS third FROM a""",
)
def numbered_answers(t):
    flat = F.regexp_replace("text", "[\n\r]", " ")
    turn = lambda n: F.coalesce(F.max(F.when(F.col("turn") == n, flat)), F.lit(""))
    said = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("1. a"), turn(0), F.lit("\n2. b"), turn(1)).alias("answer"))
    got = said.select("conv_id", text.numbered_answers("answer", F.lit(3)).alias("a"))
    return got.select("conv_id", F.col("a")[0].alias("first"), F.col("a")[1].alias("second"), F.col("a")[2].alias("third"))


@query("first_braces", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '{\"in\": ' || props || '}' END AS found FROM events")
def first_braces(t):
    nested = F.concat(F.lit("a } b {\"in\": "), "props", F.lit("} c {\"later\": 1}"))
    open_end = F.concat(F.lit("no end {"), F.col("event_type"))
    worded = F.when(F.col("event_id") % 5 == 0, open_end).otherwise(nested)
    return t.events.select("event_id", text.first_braces(worded).alias("found"))


@query(
    "tolerant_json",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events""",
)
def tolerant_json(t):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    literal = F.concat(F.regexp_replace("props", '"', "'").substr(F.lit(1), F.length("props") - 1), F.lit(", 'ok': True}"))
    broken = F.concat(F.lit("{oops "), "props")
    kind = F.col("event_id") % 4
    said = F.when(kind == 0, F.col("props")).when(kind == 1, fenced).when(kind == 2, literal).otherwise(broken)
    return t.events.select("event_id", F.try_variant_get(text.tolerant_json(said), "$.k", "bigint").alias("k"))


@query(
    "judge_ratings",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS faithful, CAST(o_custkey % 3 = 2 AS INT) AS relevant,
  CAST(o_custkey % 7 AS INT) AS verified, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 5 + 0.5 AS DOUBLE) ELSE o_custkey % 9 END AS rating,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 5 + 0.5 AS DOUBLE) ELSE o_custkey % 9 END > 1 AS good_answer FROM orders""",
)
def judge_ratings(t):
    yes = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    key = F.col("o_custkey")
    faithful = F.concat(F.lit("Because of it. **Answer:** "), yes, F.lit(" indeed"))
    score = F.concat(F.lit("Total Score: "), (key % 3).cast("string"), F.lit("/2"))
    verify = F.concat(F.lit("Rating:  "), (key % 7).cast("string"))
    double = F.concat(F.lit("Rating: [["), (key % 5).cast("string"), F.lit(".5]]"))
    single = F.concat(F.lit("Rating: ["), (key % 9).cast("string"), F.lit("]"))
    rating = F.when(key % 2 == 0, double).otherwise(single)
    return t.orders.select(
        "o_orderkey", text.faithfulness(faithful).alias("faithful"), text.relevancy(score).alias("relevant"),
        text.verification(verify).alias("verified"), text.bracket_rating(rating).alias("rating"), text.passes("good_answer", rating).alias("good_answer"),
    )


QA_SQL = f"""pieces AS (SELECT doc_id, source, text, split_part(text, {NL}, 1) AS q FROM documents),
pairs AS (
  SELECT doc_id, 0 AS pair_no, trim(q, ' \t\r\n') AS question, 'about ' || source AS answer FROM pieces
  UNION ALL SELECT doc_id, 1, 'And ' || lang, regexp_replace(text, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') FROM documents WHERE doc_id % 2 = 0)"""


@query("qa_pairs", f"WITH {QA_SQL} SELECT doc_id, pair_no, question, answer FROM pairs WHERE question <> '' AND answer <> ''")
def qa_pairs(t):
    second = F.concat(F.lit(" [End]\n[Question] And "), "lang", F.lit(" [Answer] "), "text", F.when(F.col("doc_id") % 2 == 0, " [END]").otherwise(""))
    said = F.concat(F.substring_index("text", "\n", 1), F.lit(" [Answer] about "), "source", second)
    rows = text.explode_qa(t.documents.select("doc_id", said.alias("response")), "response")
    return rows.select("doc_id", "pair_no", "question", "answer")


@query(
    "question_blocks",
    f"""WITH p AS (SELECT doc_id, regexp_replace(text, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS b, lang FROM documents)
SELECT doc_id, 0 AS block_no, lang AS block, CASE WHEN doc_id % 2 = 0 THEN b END AS context, lang AS question, b AS answer FROM p
UNION ALL SELECT doc_id, 1, b, CASE WHEN doc_id % 2 = 0 THEN b END, lang, b FROM p WHERE b <> ''""",
)
def question_blocks(t):
    blocks = F.concat(F.lit("### Question 1: "), "lang", F.lit("\n### Question 12: "), "text")
    context = F.concat(F.lit("x [Start of Context] "), "text", F.when(F.col("doc_id") % 2 == 0, "[End of Context] y").otherwise(""))
    said = F.concat(F.lit("Sure. Question: "), "lang", F.lit(" \nAnswer: "), "text")
    docs = spread_out(t.documents.select("doc_id", "text", "lang"))  # a file of few pieces would be parsed by as few tasks
    rows = docs.select("doc_id", F.explode(F.array(F.struct(text.question_blocks(blocks).alias("blocks"), text.context_block(context).alias("context"), text.question_answer(said).alias("qa")))).alias("p"))
    rows = rows.select("doc_id", F.posexplode("p.blocks").alias("block_no", "block"), "p.context", "p.qa")  # parsed once a document, not once a block
    return rows.select("doc_id", "block_no", "block", "context", "qa.question", "qa.answer")


@query(
    "parsed_instructions",
    r"""WITH p AS (SELECT doc_id, text, regexp_replace(CASE WHEN doc_id % 6 = 0 THEN 'Draw a map of ' ELSE '' END || CASE WHEN doc_id % 6 = 1 THEN 'Write a program for ' ELSE '' END || CASE WHEN doc_id % 6 = 2 THEN '(' ELSE '' END || split_part(text, chr(10), 1), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS i,
  regexp_replace(text, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS o FROM documents),
n AS (SELECT *, len(list_filter(string_split_regex(i, '\s+'), lambda x: x <> '')) AS words FROM p)
SELECT doc_id, 0 AS task_no, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE i END AS instruction, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE '' END AS "input", CASE WHEN doc_id % 6 = 5 THEN NULL ELSE o END AS output,
  CASE WHEN doc_id % 6 = 5 THEN 'format' WHEN words <= 3 OR words > 150 THEN 'words'
    WHEN regexp_matches(i, '(?i)\b(image|images|graph|graphs|picture|pictures|file|files|map|maps|draw|plot|go to|video|audio|music|flowchart|diagram)\b') THEN 'denied word'
    WHEN starts_with(i, 'Write a program') THEN 'program' WHEN regexp_matches(i, '^[[:punct:]]') THEN 'punctuation' WHEN unicode(i) > 127 THEN 'non-ascii' END AS reason FROM n""",
)
def parsed_instructions(t):
    kind = F.col("doc_id") % 6
    lead = F.when(kind == 0, "Draw a map of ").when(kind == 1, "Write a program for ").when(kind == 2, "(").otherwise("")
    full = F.concat(F.lit(" ** Instruction: "), lead, F.substring_index("text", "\n", 1), F.lit("\n** Input\n<noinput>\n** Output: "), "text")
    said = F.when(kind == 5, F.lit("only words")).otherwise(full)
    rows = text.parse_instructions(t.documents.select("doc_id", said.alias("response")), "response")
    broken = F.col("reason") == "format"
    return rows.withColumns({c: F.when(~F.coalesce(broken, F.lit(False)), F.col(c)) for c in ("instruction", "input", "output")})


@query(
    "few_shot_prompts",
    f"""SELECT o_custkey, 'Do tasks.' || {NL} || string_agg('* Task ' || CAST(rn AS VARCHAR) || {NL} || '** Instruction' || {NL} || 'Ship ' || o_orderpriority || {NL} || '** Input' || {NL} || CASE WHEN o_orderstatus = 'P' THEN '<noinput>' ELSE o_orderstatus END || {NL} || '** Output' || {NL} || CAST(o_orderkey AS VARCHAR) || {NL}, '' ORDER BY rn)
  || '* Task ' || CAST(count(*) + 1 AS VARCHAR) || {NL} AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""",
)
def few_shot_prompts(t):
    rows = t.orders.select(
        "o_custkey", "o_orderkey", F.concat(F.lit("Ship   "), "o_orderpriority", F.lit(":")).alias("instruction"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("input"), F.col("o_orderkey").cast("string").alias("output"),
    )
    return text.few_shot_prompts(rows, ["o_custkey"], "o_orderkey", "Do tasks.\n")


@query(
    "user_texts",
    f"""SELECT conv_id, coalesce(regexp_replace(string_agg(text, {NL} || {NL} ORDER BY turn) FILTER (WHERE role = 'user'), '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g'), '') AS user_text FROM conversations GROUP BY 1""",
)
def user_texts(t):
    return text.user_text(t.conversations)


@query(
    "numbered_dialogues",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg({NL} || CASE WHEN role = 'user' THEN '### User Question: ' ELSE '### Assistant Response: ' END || CAST(n AS VARCHAR) || {NL} || text || {NL}, '' ORDER BY turn) AS dialogue FROM r GROUP BY 1""",
)
def numbered_dialogues(t):
    return text.numbered_dialogue(t.conversations)


@query(
    "conversation_verdicts",
    """WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role NOT IN ('user', 'assistant', 'agent', 'system', 'developer', 'tool')) AS odd,
  count(*) FILTER (WHERE role = 'user' AND length(text) > 0) AS n_user, count(*) FILTER (WHERE role IN ('assistant', 'agent') AND length(text) > 0) AS n_answer FROM conversations GROUP BY 1)
SELECT conv_id, n_user, n_answer, CASE WHEN odd > 0 THEN 'unsupported role' WHEN n_user < 1 THEN 'no user turn' WHEN n_user > 1 AND n_user <> n_answer THEN 'unequal turns' END AS reason,
  NOT (odd > 0 OR n_user < 1 OR (n_user > 1 AND n_user <> n_answer)) AS is_valid FROM c""",
)
def conversation_verdicts(t):
    return text.conversation_verdict(t.conversations)


@query(
    "parsed_tags",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'excellent' WHEN 2 THEN 'average' WHEN 3 THEN 'poor' WHEN 4 THEN 'None' ELSE 'good' END AS tag FROM documents""",
)
def parsed_tags(t):
    kind = F.col("doc_id") % 6
    said = (
        F.when(kind == 0, '{"explanation": "fine", "input_quality": "good"}')
        .when(kind == 1, '```json\n{"input_quality": "excellent"}\n```')
        .when(kind == 2, 'I would say "input_quality": "average" here {')
        .when(kind == 3, '{"input_quality": "rather poor I think"}')
        .when(kind == 4, "no tag at all")
        .otherwise('{"input_quality": ["good", "average"]}')
    )
    return tags.parse_tag(t.documents.select("doc_id", said.alias("response")), "response", "quality").select("doc_id", "tag")


@query(
    "parsed_scores",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '4' WHEN 1 THEN '5' WHEN 2 THEN '3' END AS tag, CASE WHEN doc_id % 4 = 3 THEN 'Failed to rate for sample_quality task' END AS tag_error FROM documents""",
)
def parsed_scores(t):
    kind = F.col("doc_id") % 4
    said = F.when(kind == 0, '{"score": 4}').when(kind == 1, 'so "score": "5" it is').when(kind == 2, '[{"score": "3 of 3"}]').otherwise("nothing")
    return tags.parse_tag(t.documents.select("doc_id", said.alias("response")), "response", "sample_quality").select("doc_id", "tag", "tag_error")


@query(
    "parsed_difficulty",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'very easy' ELSE 'easy' END AS tag, CASE WHEN doc_id % 3 < 2 THEN lang END AS intent, CASE WHEN doc_id % 3 = 0 THEN source END AS knowledge FROM documents""",
)
def parsed_difficulty(t):
    kind = F.col("doc_id") % 3
    full = F.concat(F.lit('{"intent": "'), "lang", F.lit('", "knowledge": "'), "source", F.lit('", "difficulty": "hard"}'))
    half = F.concat(F.lit('{"intent": "'), "lang", F.lit('", "difficulty": "very easy"}'))
    said = F.when(kind == 0, full).when(kind == 1, half).otherwise('"difficulty": "easy", broken')
    return tags.parse_difficulty(t.documents.select("doc_id", said.alias("response")), "response").select("doc_id", "tag", "intent", "knowledge")


TAGGED_SQL = """tagged AS (
  SELECT d.doc_id AS id, CASE d.doc_id % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'excellent' WHEN 2 THEN 'great' ELSE 'poor' END AS input_quality,
    CASE d.doc_id % 7 WHEN 0 THEN 'tough' ELSE 'easy' END AS difficulty, CASE WHEN quality = 1 THEN '5' WHEN quality = 0 THEN '2' END AS judge_quality_score,
    source AS task_category, CASE WHEN d.doc_id % 11 = 0 THEN d.doc_id - 1 WHEN d.doc_id % 13 = 0 THEN d.doc_id END AS min_similar_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def tagged(t):
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    key = F.col("doc_id")
    model = lambda e: F.array(F.create_map(F.lit("other"), F.lit("x"), F.lit("model"), e), F.create_map(F.lit("second"), F.lit("y")))
    quality = F.when(key % 5 == 0, "good").when(key % 5 == 1, "excellent").when(key % 5 == 2, "great").otherwise("poor")
    return joined.select(
        key.alias("id"),
        tags.first_label(model(quality)).alias("input_quality"),
        tags.first_label(model(F.when(key % 7 == 0, "tough").otherwise("easy"))).alias("difficulty"),
        F.when(F.col("quality") == 1, "5").when(F.col("quality") == 0, "2").alias("judge_quality_score"),
        F.col("source").alias("task_category"),
        F.when(key % 11 == 0, key - 1).when(key % 13 == 0, key).alias("min_similar_id"),
    )


@query(
    "tag_value_check",
    f"""WITH {TAGGED_SQL} SELECT id, input_quality, CASE WHEN input_quality NOT IN ('very poor', 'poor', 'average', 'good', 'excellent') THEN 'input_quality'
  WHEN difficulty NOT IN ('very easy', 'easy', 'medium', 'hard', 'very hard') THEN 'difficulty' WHEN judge_quality_score NOT IN ('1', '2', '3', '4', '5') THEN 'judge_quality_score'
  WHEN length(task_category) < 1 THEN 'task_category' END AS reason FROM tagged""",
)
def tag_value_check(t):
    return tags.filter_tagged(tagged(t), "invalid_scores").select("id", "input_quality", "reason")


@query(
    "quality_gate",
    f"""WITH {TAGGED_SQL} SELECT id FROM tagged WHERE input_quality IN ('good', 'excellent') AND (judge_quality_score IS NULL OR judge_quality_score IN ('5'))
  AND difficulty IN ('very easy', 'easy', 'medium', 'hard', 'very hard') AND (min_similar_id IS NULL OR min_similar_id = id)""",
)
def quality_gate(t):
    return tags.filter_tagged(tagged(t), ["high_quality_filter"]).where("reason IS NULL").select("id")


@query(
    "collated_tags",
    "SELECT doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, 2 AS n_tags FROM labels",
)
def collated_tags(t):
    rows = t.labels.select("doc_id", F.col("quality").cast("string"), F.col("toxic").cast("string")).unpivot(["doc_id"], ["toxic", "quality"], "task", "tag")
    maps = tags.collate_tags(rows, "doc_id")
    return maps.select("doc_id", F.col("tags")["quality"].alias("quality"), F.col("tags")["toxic"].alias("toxic"), F.size("tags").alias("n_tags"))


@query(
    "flattened_texts",
    """SELECT c_custkey, c_name AS content FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 2""",
)
def flattened_texts(t):
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    obj = lambda c: F.concat(F.lit('{"content": '), quoted(c), F.lit("}"))
    many = F.concat(F.lit("["), quoted("c_name"), F.lit(", "), obj("c_mktsegment"), F.lit("]"))
    kind = F.col("c_custkey") % 3
    said = F.when(kind == 0, quoted("c_name")).when(kind == 1, obj("c_name")).otherwise(many)
    return text.flatten_texts(t.customer.select("c_custkey", F.parse_json(said).alias("docs")), "docs")


@query("rendered_rows", "SELECT c_custkey, 'Customer ' || c_name || ' buys for ' || c_mktsegment || '.' AS line FROM customer")
def rendered_rows(t):
    return t.customer.select("c_custkey", text.render("Customer {{c_name}} buys for {{ c_mktsegment }}.").alias("line"))


@query(
    "filled_slots",
    """WITH f AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS r FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, 'A ' || coalesce(a.r, '<|prompt 1|>') || ' B ' || coalesce(b.r, '<|prompt 2|>') || '.' AS text FROM orders
LEFT JOIN f a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 LEFT JOIN f b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2""",
)
def filled_slots(t):
    rows = t.orders.select("o_orderkey", F.lit("A <|prompt 1|> B <|prompt 2|>.").alias("text"))
    flag = F.concat("l_returnflag", "l_linestatus")
    replies = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("bigint").alias("prompt_no")).agg(F.min(flag).alias("reply"))
    return text.fill_slots(rows, replies, "o_orderkey", "text")


LINE_SERIES_SQL = """s AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS p FROM lineitem GROUP BY 1)"""


def line_series(t):
    """Quantities and prices of an order's lines as two short series."""
    order = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("r"))
    return rows.select("l_orderkey", F.col("r.l_quantity").alias("q"), F.col("r.l_extendedprice").alias("p"))


@query(
    "series_in_text",
    f"""WITH {LINE_SERIES_SQL} SELECT l_orderkey, 'Q <ts>[' || array_to_string(list_transform(q, lambda x: printf('%.3f', x)), ', ') || ']<ts/> P <ts>[' || array_to_string(list_transform(p, lambda x: printf('%.3f', x)), ', ') || ']<ts/>.' AS prompt,
  'Q <ts><ts/> P <ts><ts/>.' AS blanked, q AS first_series FROM s""",
)
def series_in_text(t):
    said = line_series(t).select("l_orderkey", text.splice_series(F.lit("Q <ts><ts/> P <ts><ts/>."), F.array("q", "p")).alias("prompt"))
    return said.select("l_orderkey", "prompt", text.blank_series("prompt").alias("blanked"), text.extract_series("prompt")[0].alias("first_series"))


def _encoded_sql(values):
    return f"""WITH {LINE_SERIES_SQL}, m AS (SELECT l_orderkey, p, list_avg(p) AS mu FROM s), d AS (SELECT l_orderkey, mu, list_transform(p, lambda x: x - mu) AS dev FROM m),
f AS (SELECT *, list_max(list_transform(dev, lambda x: abs(x))) AS top FROM d), g AS (SELECT l_orderkey, mu, dev, CASE WHEN top >= 3 THEN top / 3 ELSE 1 END AS sf FROM f)
SELECT l_orderkey, {values} AS encoded, round(-mu, 6) AS "offset", round(sf, 6) AS scale_factor FROM g"""


def _encoded(t, method):
    rows = encoding.encode(line_series(t).drop("q"), "p", method)
    return rows.select("l_orderkey", encoding.round_nested("encoded", 5).alias("encoded"), F.round("offset", 6).alias("offset"), F.round("scale_factor", 6).alias("scale_factor"))


@query("encoded_series", _encoded_sql("list_transform(dev, lambda x: round(x / sf, 5))"))
def encoded_series(t):
    return _encoded(t, "minmax_scale")


@query("encoded_series_pairs", _encoded_sql("flatten(list_transform(dev, lambda x: [round(x / sf, 5), 1.0]))"))
def encoded_series_pairs(t):
    return _encoded(t, "sp")


@query("plain_series", f"WITH {LINE_SERIES_SQL} SELECT l_orderkey, p AS encoded, '<ts><ts/>' AS prompt FROM s")
def plain_series(t):
    return encoding.encode(line_series(t).drop("q"), "p", "no").select("l_orderkey", "encoded", "prompt")


@query(
    "padded_series",
    f"""WITH {LINE_SERIES_SQL}, b AS (SELECT *, l_orderkey // 100 AS batch FROM s), n AS (SELECT batch, max(len(q)) AS n FROM b GROUP BY 1)
SELECT batch, l_orderkey, list_concat(q, list_transform(range(0, n - len(q)), lambda x: 0.0)) AS q FROM b JOIN n USING (batch)""",
)
def padded_series(t):
    batches = line_series(t).select(F.floor(F.col("l_orderkey") / 100).alias("batch"), "l_orderkey", "q")
    return encoding.pad_batch(batches, ["batch"], "q")


VEC_COLS = ["value_0", "value_1", "value_2"]


def vec_rows(t):
    return t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VEC_COLS)])


@query(
    "rows_as_text",
    """WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, printf('value_0 is %.4f, value_1 is %.4f, value_2 is %.4f', a, b, c) AS base,
  printf('Input: value_0 is [blank], value_1 is [blank], value_2 is [blank] [sep] Target: %.4f [answer] %.4f [answer] %.4f [answer]', a, b, c) AS fim FROM v""",
)
def rows_as_text(t):
    return vec_rows(t).select(
        "vec_id", encoding.row_to_text(VEC_COLS, template="base_template").alias("base"), encoding.row_to_text(VEC_COLS).alias("fim")
    )


@query(
    "text_round_trip",
    "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS value_0, round(CAST(embedding[2] AS DOUBLE), 4) AS value_1, round(CAST(embedding[3] AS DOUBLE), 4) AS value_2 FROM embeddings",
)
def text_round_trip(t):
    said = vec_rows(t).select("vec_id", encoding.row_to_text(VEC_COLS).alias("said"))
    return encoding.text_to_row(said, "said", VEC_COLS)


@query(
    "split_norms",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm_0,
  round(sqrt(list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm_1 FROM embeddings""",
)
def split_norms(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(encoding.norm(e, 0, 32), 5).alias("norm_0"), F.round(encoding.norm(e, 32, 32), 5).alias("norm_1"))


@query(
    "exploded_replies",
    """SELECT o_orderkey, 0 AS qa_no, o_orderstatus AS question, o_orderpriority AS answer FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 1, 'n', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 5 <> 0""",
)
def exploded_replies(t):
    good = F.concat(
        F.lit('[{"question": "'), "o_orderstatus", F.lit('", "answer": "'), "o_orderpriority", F.lit('"}, {"question": "n", "answer": "'), F.col("o_custkey").cast("string"), F.lit('"}]')
    )
    said = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a list")).otherwise(good)
    parsed = F.try_variant_get(text.tolerant_json(said), "$", "array<struct<question:string,answer:string>>")
    rows = t.orders.select("o_orderkey", F.posexplode(parsed).alias("qa_no", "qa"))
    return rows.select("o_orderkey", "qa_no", "qa.question", "qa.answer")
