"""Row shaping, validation, look-ups, sampling, set and scene-graph queries."""

from pyspark.sql import functions as F

from tidewright.functions.draws import sql_draw
from tidewright.operators import graph, relational as rel
from tidewright.plans.registry import query

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


@query(
    "mapped_fields",
    "SELECT c_nationkey, c_acctbal, c_custkey AS id, c_name AS content, c_mktsegment AS segment FROM customer",
)
def mapped_fields(t):
    out = rel.map_fields(t.customer, {"*": "*", "c_custkey": "id", "c_name": "content", "c_mktsegment": "meta.segment"})
    return out.select("c_nationkey", "c_acctbal", "id", "content", "meta.segment")


@query(
    "path_reads",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type AS first_item, 2 AS n_head, 1 AS n_tail FROM events""",
)
def path_reads(t):
    doc = F.struct(F.struct(F.expr(K).alias("k")).alias("b"), F.array("event_type", F.col("user_id").cast("string"), F.lit("x")).alias("c")).alias("a")
    rows = t.events.select("event_id", doc)
    return rows.select(
        "event_id", rel.get_path("a.b.k").alias("k"), rel.get_path("a.c[0]").alias("first_item"),
        F.size(rel.get_path("a.c[:2]")).alias("n_head"), F.size(rel.get_path("a.c[2:]")).alias("n_tail"),
    )


@query("path_writes", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation FROM customer")
def path_writes(t):
    rows = t.customer.select("c_custkey", F.struct("c_name").alias("a"), "c_mktsegment", "c_nationkey")
    rows = rel.set_path(rows, "a.b.segment", F.col("c_mktsegment"))
    rows = rel.set_path(rows, "z.y.nation", F.col("c_nationkey"))
    return rows.select("c_custkey", F.col("a.c_name").alias("name"), F.col("a.b.segment").alias("segment"), F.col("z.y.nation").alias("nation"))


@query(
    "copied_fields",
    "SELECT l_orderkey AS l_orderkey, l_orderkey AS l_partkey, l_suppkey AS l_linenumber, l_partkey AS l_suppkey FROM lineitem",
)
def copied_fields(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rel.copy_fields(rows, {"l_orderkey": "l_partkey", "l_suppkey": "l_linenumber", "l_partkey": "l_suppkey"})


@query("block_with_maps", "SELECT c_custkey, c_name, upper(c_name) AS shouted FROM customer")
def block_with_maps(t):
    block = lambda df: df.withColumn("out", F.upper("text"))
    return rel.apply_block(t.customer.select("c_custkey", "c_name"), block, {"c_name": "text"}, {"out": "shouted"}, required=["text"])


@query(
    "flattened_field",
    "SELECT o_custkey, unnest(list(o_orderpriority ORDER BY o_orderkey)) AS p FROM orders GROUP BY 1",
)
def flattened_field(t):
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"))
    return rel.flatten_field(lists, "p")


@query(
    "flattened_by_table_function",
    """WITH e AS (SELECT o_orderkey, o_custkey, unnest([o_orderpriority, o_orderstatus]) AS p, unnest([1, 2]) AS k FROM orders)
SELECT o_custkey, o_orderkey, p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, k) AS element_no FROM e""",
)
def flattened_by_table_function(t):
    rel.register_flatten(t.spark)
    lists = t.orders.select("o_custkey", "o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("p"))
    return t.spark.sql("SELECT * FROM flatten_rows(TABLE({lists}) PARTITION BY o_custkey ORDER BY (o_orderkey), 'p')", lists=lists)


@query(
    "questions_of_responses",
    """WITH q AS (SELECT o_orderkey, o_orderstatus AS s, 'What is ' || o_orderpriority || '?' AS a, 'Who ordered ' || CAST(o_custkey AS VARCHAR) || '?' AS b FROM orders)
SELECT o_orderkey, 1 AS question_no, a AS question FROM q UNION ALL SELECT o_orderkey, 2, b FROM q WHERE s <> 'F'""",
)
def questions_of_responses(t):
    rel.register_questions(t.spark)
    second = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("2) Who ordered "), F.col("o_custkey").cast("string"), F.lit("?"))).otherwise("No more.")
    said = F.concat(F.lit("Some questions:\n - What is "), "o_orderpriority", F.lit("?\n\n"), second)
    responses = t.orders.select("o_orderkey", said.alias("said"))
    return t.spark.sql("SELECT r.o_orderkey, q.question_no, q.question FROM {responses} r, LATERAL response_questions(r.said) q", responses=responses)


CRITERIA_SQL = """judged AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT (l_quantity > 5) THEN 'quantity' WHEN NOT (l_discount < 0.09) THEN 'discount'
  WHEN NOT (l_returnflag <> 'R') THEN 'returned' END AS reason FROM lineitem)"""
CRITERIA = {"quantity": "l_quantity > 5", "discount": "l_discount < 0.09", "returned": "l_returnflag <> 'R'"}


def _judged(t):
    return rel.first_failed({n: F.expr(e) for n, e in CRITERIA.items()})


@query("criteria_chain", f"WITH {CRITERIA_SQL} SELECT *, reason IS NULL AS is_valid FROM judged")
def criteria_chain(t):
    kept, _ = rel.split_valid(t.lineitem, _judged(t), keep_all=True)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "reason", "is_valid")


@query("rejected_rows", f"WITH {CRITERIA_SQL} SELECT l_orderkey, l_linenumber, l_partkey, reason FROM judged WHERE reason IS NOT NULL")
def rejected_rows(t):
    _, rejected = rel.split_valid(t.lineitem, _judged(t))
    return rejected.select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query(
    "before_after_counts",
    f"WITH {CRITERIA_SQL} SELECT l_returnflag, count(*) AS n_before, count(*) FILTER (WHERE l_quantity > 5 AND l_discount < 0.09 AND l_returnflag <> 'R') AS n_after FROM lineitem GROUP BY 1",
)
def before_after_counts(t):
    kept, _ = rel.split_valid(t.lineitem, _judged(t))
    return rel.before_after(t.lineitem, kept, "l_returnflag")


@query("complete_numbers", "SELECT event_id, CAST(v AS DOUBLE) AS v FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NaN-ish' WHEN 1 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS v FROM events) WHERE try_cast(v AS DOUBLE) IS NOT NULL")
def complete_numbers(t):
    said = F.when(F.col("event_id") % 4 == 0, "NaN-ish").when(F.col("event_id") % 4 > 1, F.col("user_id").cast("string"))
    return t.events.select("event_id", said.try_cast("double").alias("v")).dropna()


ANSWERS_SQL = """ans AS (SELECT l_orderkey AS idx, l_linenumber AS part_no, l_partkey AS pos, l_returnflag || CAST(l_suppkey AS VARCHAR) AS response,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem)"""


@query(
    "joined_answers",
    f"WITH {ANSWERS_SQL} SELECT o_orderkey AS idx, coalesce(response, '') AS response FROM orders LEFT JOIN ans ON idx = o_orderkey AND rn = 1",
)
def joined_answers(t):
    answers = t.lineitem.select(
        F.col("l_orderkey").alias("idx"), "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("response")
    )
    last = rel.latest(answers, ["idx"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("idx", "response")
    samples = t.orders.select(F.col("o_orderkey").alias("idx"))
    return samples.join(last, "idx", "left").withColumn("response", F.coalesce("response", F.lit("")))


@query(
    "cached_responses",
    """SELECT o_orderkey, CASE WHEN c.n IS NOT NULL THEN 'hit' ELSE 'miss' END AS state FROM orders
LEFT JOIN (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) c USING (o_custkey, o_orderpriority)""",
)
def cached_responses(t):
    asked = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    key = F.sha2(F.to_json(F.struct("o_custkey", "o_orderpriority")), 256)
    cache = t.orders.where("o_orderstatus = 'F'").groupBy(key.alias("request_key")).agg(F.max("o_orderkey").cast("string").alias("response"))
    hits, misses = rel.with_cache(asked, cache, ["o_custkey", "o_orderpriority"])
    return hits.select("o_orderkey", F.lit("hit").alias("state")).unionByName(misses.select("o_orderkey", F.lit("miss").alias("state")))


@query(
    "rows_per_task",
    """SELECT conv_id, turn, t AS task FROM conversations, (VALUES ('quality'), ('sample_quality'), ('difficulty')) v(t)
WHERE t = 'quality' OR (t = 'sample_quality' AND role = 'assistant') OR (t = 'difficulty' AND role = 'user')""",
)
def rows_per_task(t):
    rows = t.conversations.select("conv_id", "turn", "role")
    tasks = {"quality": F.lit(True), "sample_quality": F.col("role") == "assistant", "difficulty": F.col("role") == "user"}
    return rel.per_task(rows, tasks).drop("role")


@query(
    "few_shot_groups",
    f"""WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY {sql_draw(3, 'p_partkey')}, p_partkey) - 1 AS rn FROM part),
g AS (SELECT p_type, rn // 60 AS group_no, list(p_partkey ORDER BY rn) AS ids FROM r GROUP BY 1, 2)
SELECT d.item_id, g.p_type, CAST(g.group_no AS BIGINT) AS group_no, ids FROM benchmark d JOIN g ON g.p_type = CASE d.item_id % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' ELSE 'LARGE' END""",
)
def few_shot_groups(t):
    groups = rel.example_groups(t.part.select("p_type", "p_partkey"), "p_type", "p_partkey", 60, seed=3)
    kind = F.when(F.col("item_id") % 3 == 0, "ECONOMY").when(F.col("item_id") % 3 == 1, "SMALL").otherwise("LARGE")
    docs = t.benchmark.select("item_id", kind.alias("p_type"))
    return rel.few_shot(docs, groups, "p_type").select("item_id", "p_type", "group_no", F.col("examples.p_partkey").alias("ids"))


@query(
    "few_shot_drawn",
    f"""WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY {sql_draw(3, 'p_partkey')}, p_partkey) - 1 AS rn FROM part),
g AS (SELECT p_type, rn // 20 AS group_no, list(p_partkey ORDER BY rn) AS ids FROM r GROUP BY 1, 2),
n AS (SELECT p_type, count(*) AS n FROM g GROUP BY 1),
d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' ELSE 'LARGE' END AS p_type FROM documents),
k AS (SELECT doc_id, p_type, n, unnest(range(0, least(2, n))) AS k FROM d JOIN n USING (p_type))
SELECT doc_id, k.p_type, CAST(g.group_no AS BIGINT) AS group_no, ids FROM k JOIN g ON g.p_type = k.p_type AND g.group_no = ({sql_draw(4, 'doc_id')} + k) % n""",
)
def few_shot_drawn(t):
    groups = rel.example_groups(t.part.select("p_type", "p_partkey"), "p_type", "p_partkey", 20, seed=3)
    kind = F.when(F.col("doc_id") % 3 == 0, "ECONOMY").when(F.col("doc_id") % 3 == 1, "SMALL").otherwise("LARGE")
    out = rel.few_shot_drawn(t.documents.select("doc_id", kind.alias("p_type")), groups, "p_type", "doc_id", 2, seed=4)
    return out.select("doc_id", "p_type", "group_no", F.col("examples.p_partkey").alias("ids"))


@query(
    "request_batches",
    """SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1) // 20 AS batch_no FROM orders""",
)
def request_batches(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return rel.request_batches(rows, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 20, 1000).select("o_orderkey", "batch_no")


@query(
    "next_batch",
    f"""(SELECT o_orderkey, true AS is_seed FROM orders WHERE o_orderkey > 120 ORDER BY o_orderkey LIMIT 12)
UNION ALL (SELECT l_orderkey, false FROM (SELECT DISTINCT l_orderkey FROM lineitem) ORDER BY {sql_draw(11, 'l_orderkey')}, l_orderkey LIMIT 9)""",
)
def next_batch(t):
    machine = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return rel.next_batch(t.orders.select("o_orderkey"), machine, "o_orderkey", 120, 12, 9, seed=11)


@query("shuffled_rows", f"SELECT c_custkey, {sql_draw(5, 'c_custkey')} AS place FROM customer")
def shuffled_rows(t):
    return rel.shuffle(t.customer.select("c_custkey"), "c_custkey", 5).withColumn("place", rel.draw(5, F.col("c_custkey")))


@query("train_share", f"SELECT c_custkey, {sql_draw(9, 'c_custkey')} / 4294967296.0 < 0.8 AS is_train FROM customer")
def train_share(t):
    train, rest = rel.split_share(t.customer.select("c_custkey"), "c_custkey", 0.8, 9)
    return train.withColumn("is_train", F.lit(True)).unionByName(rest.withColumn("is_train", F.lit(False)))


@query(
    "balanced_rows",
    f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {sql_draw(2, 'doc_id')}, doc_id) AS rn FROM labels) WHERE rn <= 30""",
)
def balanced_rows(t):
    return rel.balanced(t.labels.select("doc_id", "quality"), "quality", "doc_id", 30, seed=2)


@query("sampled_channels")
def sampled_channels(t):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(f"ch_{c}") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return rel.sample_columns(wide, ["l_orderkey", "l_linenumber"], "ch_", 2, seed=4)


@query("first_lines", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def first_lines(t):
    return t.events.select("event_id", "event_type").orderBy("event_id").limit(100)


@query(
    "distinct_rounded",
    """SELECT CAST(batch AS BIGINT) AS batch, id, v, w FROM (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY batch, id) AS rn
  FROM (SELECT l_linenumber AS batch, l_orderkey * 10000 + l_partkey AS id, round(l_discount * 1.0004, 3) AS v, round(l_tax * 1.0004, 3) AS w FROM lineitem)) WHERE rn = 1""",
)
def distinct_rounded(t):
    rows = t.lineitem.select(
        F.col("l_linenumber").cast("bigint").alias("batch"), (F.col("l_orderkey") * 10000 + F.col("l_partkey")).alias("id"),
        (F.col("l_discount") * 1.0004).alias("v"), (F.col("l_tax") * 1.0004).alias("w"),
    )
    return rel.distinct_rounded(rows, ["v", "w"], "batch", "id")


@query(
    "concatenated",
    "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier",
)
def concatenated(t):
    return rel.concat_all(
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("segment")),
    )


@query(
    "new_since",
    "SELECT min(o_custkey) AS first_new, max(o_custkey) AS last_new, count(DISTINCT o_custkey) AS n_new FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def new_since(t):
    return rel.new_since(t.orders.select("o_custkey"), t.orders.where("o_orderstatus = 'P'").select("o_custkey"), "o_custkey")


SETS_SQL = """sets AS (SELECT l_orderkey, list(l_returnflag) AS flags, list(CAST(l_linenumber AS BIGINT)) AS nums FROM lineitem GROUP BY 1)"""


@query(
    "array_set_checks",
    f"""WITH {SETS_SQL} SELECT l_orderkey, len(list_distinct(nums)) < len(nums) AS repeated, len(list_filter(flags, lambda f: f NOT IN ('A', 'N'))) = 0 AS known,
  CAST(len(list_filter(list_distinct(nums), lambda n: n > 3)) AS INT) AS n_unused FROM sets""",
)
def array_set_checks(t):
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"), F.collect_list(F.col("l_linenumber").cast("bigint")).alias("nums"))
    return sets.select(
        "l_orderkey", rel.has_duplicates(F.col("nums")).alias("repeated"),
        rel.is_subset(F.col("flags"), F.array(F.lit("A"), F.lit("N"))).alias("known"),
        F.size(F.array_except("nums", F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]))).alias("n_unused"),
    )


@query(
    "common_candidates",
    """WITH f AS (SELECT DISTINCT l_suppkey % 10 AS g, l_returnflag AS r, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
c AS (SELECT g, n FROM f GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT r) FROM f x WHERE x.g = f.g))
SELECT g, list(n ORDER BY n) AS common FROM c GROUP BY 1""",
)
def common_candidates(t):
    few = t.lineitem.select((F.col("l_suppkey") % 10).alias("g"), "l_returnflag", F.col("l_linenumber").cast("bigint").alias("n")).distinct()
    lists = few.groupBy("g", "l_returnflag").agg(F.collect_list("n").alias("ns")).groupBy("g").agg(F.collect_list("ns").alias("lists"))
    return lists.select("g", F.array_sort(rel.common_to_all("lists")).alias("common")).where(F.size("common") > 0)


@query(
    "set_f1",
    """WITH a AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS x, list_distinct(list(l_linestatus || CASE WHEN l_quantity > 25 THEN '' ELSE 'x' END)) AS y FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, x, list_distinct(list_transform(y, lambda v: CASE v WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END)) AS y FROM a)
SELECT l_orderkey, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS f1 FROM b""",
)
def set_f1(t):
    mark = F.concat("l_linestatus", F.when(F.col("l_quantity") > 25, "").otherwise("x"))
    label = F.when(mark == "F", "A").when(mark == "O", "N").otherwise("R")
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("x"), F.collect_set(label).alias("y"))
    return sets.select("l_orderkey", F.round(rel.set_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query(
    "same_trend_groups",
    """WITH s AS (SELECT o_custkey % 200 AS system_id, o_orderkey AS metric, o_orderstatus AS trend FROM orders)
SELECT system_id, trend, list(metric ORDER BY metric) AS metrics FROM s WHERE trend <> 'P' GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def same_trend_groups(t):
    rows = t.orders.select((F.col("o_custkey") % 200).alias("system_id"), F.col("o_orderkey").alias("metric"), F.col("o_orderstatus").alias("trend"))
    grouped = rows.where("trend <> 'P'").groupBy("system_id", "trend").agg(F.array_sort(F.collect_list("metric")).alias("metrics"))
    return grouped.where(F.size("metrics") >= 2)


# Scene graph -------------------------------------------------------------------------------

NODES = """p_partkey AS id, replace(p_name, ' ', '_') AS class_name, CASE WHEN p_partkey BETWEEN 1 AND 8 THEN 'Rooms' ELSE p_type END AS category,
  CASE WHEN p_size % 3 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS state, p_retailprice AS price, p_size"""
SCENE_SQL = f"""nodes AS (SELECT {NODES} FROM part),
inside AS (SELECT p_partkey AS id, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
edges AS (
  SELECT id AS from_id, 'INSIDE' AS relation, parent AS to_id FROM inside
  UNION ALL SELECT DISTINCT l_partkey, CASE l_returnflag WHEN 'A' THEN 'ON' WHEN 'R' THEN 'CLOSE' ELSE 'HOLDS_RH' END, l_suppkey FROM lineitem)"""


def scene(t):
    nodes = t.part.select(
        F.lit(0).cast("bigint").alias("scene"), F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("class_name"),
        F.when(F.col("p_partkey").between(1, 8), "Rooms").otherwise(F.col("p_type")).alias("category"),
        F.array(F.when(F.col("p_size") % 3 == 0, "OPEN").otherwise("CLOSED")).alias("states"),
        F.array(F.col("p_brand")).alias("properties"), "p_size",
    )
    inside = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("from_id"), F.lit("INSIDE").alias("relation"), F.floor(F.col("p_partkey") / 3).alias("to_id"))
    relation = F.when(F.col("l_returnflag") == "A", "ON").when(F.col("l_returnflag") == "R", "CLOSE").otherwise("HOLDS_RH")
    other = t.lineitem.select(F.col("l_partkey").alias("from_id"), relation.alias("relation"), F.col("l_suppkey").alias("to_id")).distinct()
    return nodes, inside.unionByName(other).select(F.lit(0).cast("bigint").alias("scene"), "*")


@query(
    "nodes_with_relation",
    f"""WITH {SCENE_SQL}, open AS (SELECT id FROM nodes WHERE state = 'OPEN'),
a AS (SELECT from_id, count(*) AS n FROM edges WHERE relation = 'ON' AND to_id IN (SELECT id FROM open) GROUP BY 1)
SELECT id, class_name FROM nodes WHERE id IN (SELECT from_id FROM a WHERE n >= 4) AND id IN (SELECT from_id FROM edges WHERE relation = 'CLOSE' AND to_id IN (SELECT id FROM open))
  AND NOT (category = 'Rooms')""",
)
def nodes_with_relation(t):
    nodes, edges = scene(t)
    opened = nodes.where(graph.attr_has("states", "OPEN"))
    many = graph.with_relation(nodes, edges, "ON", opened, at_least=4)
    both = graph.with_relations(many, edges, [("ON", opened), ("CLOSE", opened)])
    return both.where(~graph.is_room()).select("id", "class_name")


@query("scene_rooms", f"WITH {SCENE_SQL} SELECT class_name, min(id) AS room_id FROM nodes WHERE category = 'Rooms' GROUP BY 1")
def scene_rooms(t):
    nodes, _ = scene(t)
    return nodes.where(graph.is_room()).groupBy("class_name").agg(F.min("id").alias("room_id"))


@query(
    "unique_graph",
    """WITH e AS (SELECT l_partkey AS from_id, l_returnflag AS relation, l_suppkey AS to_id, l_quantity AS w, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS tie FROM lineitem)
SELECT from_id, relation, to_id, max_by(w, (seq, tie)) AS w FROM e GROUP BY 1, 2, 3""",
)
def unique_graph(t):
    edges = t.lineitem.select(
        F.lit(0).alias("scene"), F.col("l_partkey").alias("from_id"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("to_id"),
        F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("tie"),
    )
    nodes = t.part.select(F.lit(0).alias("scene"), F.col("p_partkey").alias("id"), F.lit(0).alias("seq"), F.lit(0).alias("tie"))
    _, unique = graph.unique_graph(nodes, edges, ["seq", "tie"])
    return unique.select("from_id", "relation", "to_id", "w")


@query(
    "nearest_objects",
    """WITH o AS (SELECT p_partkey AS id, p_type AS class_name, p_retailprice % 97 AS x, p_retailprice % 89 AS y, CAST(p_partkey % 7 AS DOUBLE) AS z FROM part),
p AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'SMALL' ELSE 'NOWHERE' END AS class_name, c_acctbal % 97 AS x, c_acctbal % 89 AS y, CAST(c_custkey % 7 AS DOUBLE) AS z FROM customer)
SELECT c_custkey, coalesce(min_by(o.id, (pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2), o.id)), -1) AS nearest_id,
  round(sqrt(min(pow(p.x - o.x, 2) + pow(p.y - o.y, 2) + pow(p.z - o.z, 2))), 5) AS distance FROM p LEFT JOIN o ON o.class_name = p.class_name GROUP BY 1""",
)
def nearest_objects(t):
    objects = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("class_name"), (F.col("p_retailprice") % 97).alias("x"), (F.col("p_retailprice") % 89).alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z")
    )
    kind = F.when(F.col("c_nationkey") % 3 == 0, "ECONOMY").when(F.col("c_nationkey") % 3 == 1, "SMALL").otherwise("NOWHERE")
    points = t.customer.select("c_custkey", kind.alias("class_name"), (F.col("c_acctbal") % 97).alias("x"), (F.col("c_acctbal") % 89).alias("y"), (F.col("c_custkey") % 7).cast("double").alias("z"))
    found = graph.nearest(points, objects, ["class_name"], "c_custkey", cell=8.0)
    return found.select("c_custkey", "nearest_id", F.round("distance", 5).alias("distance"))


@query(
    "sub_graph",
    f"""WITH {SCENE_SQL}, cls AS (SELECT DISTINCT class_name FROM nodes WHERE class_name LIKE 'red%' OR class_name LIKE '%bolt'),
kept AS (SELECT n.*, CASE WHEN n.class_name LIKE '%bolt' THEN replace(n.class_name, 'bolt', 'screw') ELSE n.class_name END AS script FROM nodes n WHERE class_name IN (SELECT class_name FROM cls))
SELECT 'node' AS part, id AS a, script AS b, CAST(NULL AS BIGINT) AS c FROM kept
UNION ALL SELECT 'edge', from_id, relation, to_id FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept)
UNION ALL SELECT 'dropped', id, class_name, NULL FROM nodes WHERE id NOT IN (SELECT id FROM kept)""",
)
def sub_graph(t):
    nodes, edges = scene(t)
    classes = nodes.where("class_name LIKE 'red%' OR class_name LIKE '%bolt'").select("class_name").distinct()
    names = nodes.where("class_name LIKE '%bolt'").select("class_name", F.initcap(F.regexp_replace(F.regexp_replace("class_name", "bolt", "screw"), "_", " ")).alias("script_name")).distinct()
    props = classes.select("class_name", F.array(F.lit("GRABBABLE")).alias("properties"))
    kept, inner, dropped = graph.sub_graph(nodes, edges, classes, names, props)
    none = F.lit(None).cast("bigint")
    return (
        kept.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("class_name").alias("b"), none.alias("c"))
        .unionByName(inner.select(F.lit("edge").alias("part"), F.col("from_id").alias("a"), F.col("relation").alias("b"), F.col("to_id").alias("c")))
        .unionByName(dropped.select(F.lit("dropped").alias("part"), F.col("id").alias("a"), F.col("class_name").alias("b"), none.alias("c")))
    )


VISIBLE_SQL = f"""WITH RECURSIVE {SCENE_SQL},
agents AS (SELECT id AS agent FROM nodes WHERE p_size = 50),
rooms AS (SELECT agent, parent AS room FROM agents JOIN inside ON inside.id = agent),
tree(room, id) AS (SELECT DISTINCT r.room, i.id FROM rooms r JOIN inside i ON i.parent = r.room UNION SELECT t.room, i.id FROM tree t JOIN inside i ON i.parent = t.id),
seen AS (
  SELECT r.agent, t.id FROM rooms r JOIN tree t ON t.room = r.room JOIN inside i ON i.id = t.id JOIN nodes p ON p.id = i.parent WHERE p.category = 'Rooms' OR p.state = 'OPEN'
  UNION SELECT agent, id FROM agents, nodes WHERE category = 'Rooms'
  UNION SELECT agent, to_id FROM agents JOIN edges ON from_id = agent AND relation LIKE 'HOLDS%')"""


@query("visible_objects", VISIBLE_SQL + " SELECT agent, id FROM seen")
def visible_objects(t):
    nodes, edges = scene(t)
    agents = nodes.where("p_size = 50").select("scene", F.col("id").alias("agent"))
    return graph.visible(nodes, edges, agents).select("agent", "id")


@query(
    "visible_edges",
    VISIBLE_SQL + " SELECT a.agent, e.from_id, e.relation, e.to_id FROM edges e JOIN seen a ON a.id = e.from_id JOIN seen b ON b.agent = a.agent AND b.id = e.to_id",
)
def visible_edges(t):
    nodes, edges = scene(t)
    agents = nodes.where("p_size = 50").select("scene", F.col("id").alias("agent"))
    return graph.visible_edges(edges, graph.visible(nodes, edges, agents)).select("agent", "from_id", "relation", "to_id")


@query(
    "replacement_containers",
    """WITH held AS (SELECT DISTINCT l_orderkey AS container, l_returnflag AS object, l_linestatus AS relation FROM lineitem),
allowed AS (SELECT DISTINCT l_returnflag AS object, l_linestatus AS relation, l_suppkey AS candidate FROM lineitem),
need AS (SELECT h.* FROM held h WHERE EXISTS (SELECT 1 FROM allowed a WHERE a.object = h.object AND a.relation = h.relation)),
w AS (SELECT container, string_agg(object || relation, ',' ORDER BY object || relation) AS wants FROM need GROUP BY 1),
d AS (SELECT DISTINCT wants, unnest(string_split(wants, ',')) AS want FROM w),
o AS (SELECT wants, candidate FROM d JOIN allowed ON object || relation = want GROUP BY 1, 2 HAVING count(*) = len(string_split(wants, ','))),
m AS (SELECT container, count(*) AS n, min(candidate) AS low FROM w JOIN o USING (wants) WHERE candidate <> container GROUP BY 1)
SELECT 'container' AS part, container AS id, wants, coalesce(n, 0) AS candidates, low AS first_candidate FROM w LEFT JOIN m USING (container) UNION ALL SELECT 'candidate', candidate, wants, NULL, NULL FROM o""",
)
def replacement_containers(t):
    held = t.lineitem.select(F.lit(0).alias("scene"), F.col("l_orderkey").alias("container"), F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("relation"))
    allowed = t.lineitem.select(F.col("l_returnflag").alias("object"), F.col("l_linestatus").alias("relation"), F.col("l_suppkey").alias("candidate"))
    needs, offers = graph.replacement_summary(held, allowed)
    name = F.array_join(F.transform("wants", lambda w: F.concat(w["object"], w["relation"])), ",").alias("wants")
    containers = needs.select(F.lit("container").alias("part"), F.col("container").alias("id"), name, "candidates", "first_candidate")
    return containers.unionByName(offers.select(F.lit("candidate").alias("part"), F.col("candidate").alias("id"), name), allowMissingColumns=True)


@query(
    "replacement_variants",
    """WITH v AS (SELECT c_custkey, unnest(range(0, 5)) AS variant, c_nationkey AS n FROM customer)
SELECT c_custkey AS program, variant, '[Grab] <' || CASE variant % 2 WHEN 0 THEN 'cup' ELSE 'mug' || CAST(n AS VARCHAR) END || '> (1) <' || CASE (variant // 2) % 3 WHEN 0 THEN 'desk' WHEN 1 THEN 'table' ELSE 'shelf' END || '> (2)' AS text FROM v""",
)
def replacement_variants(t):
    programs = t.customer.select(F.col("c_custkey").alias("program"), F.lit("[Grab] <cup> (1) <desk> (2)").alias("text"), "c_nationkey")
    slot = lambda n, o, opts: F.struct(F.lit(n).alias("slot"), F.lit(o).alias("original"), F.array(*opts).alias("options"))
    mug = F.concat(F.lit("<mug"), F.col("c_nationkey").cast("string"), F.lit("> (1)"))
    slots = F.array(
        slot(1, "<cup> (1)", [F.lit("<cup> (1)"), mug]),
        slot(2, "<desk> (2)", [F.lit("<desk> (2)"), F.lit("<table> (2)"), F.lit("<shelf> (2)")]),
    )
    choices = programs.select("program", F.explode(slots).alias("s")).select("program", "s.*")
    return graph.replacement_variants(programs.select("program", "text"), choices, 5)


@query(
    "expanded_synonyms",
    """WITH x AS (SELECT p_partkey, p_brand, unnest(list_distinct([p_name, p_type || ' thing'])) AS class_name FROM part)
SELECT class_name, max_by(p_brand, p_partkey) AS p_brand, max(p_partkey) AS p_partkey FROM x GROUP BY 1""",
)
def expanded_synonyms(t):
    rows = t.part.select(F.col("p_name").alias("class_name"), "p_brand", "p_partkey", F.array(F.concat("p_type", F.lit(" thing"))).alias("syn"))
    return graph.expand_synonyms(rows, "class_name", "syn", "p_partkey")


ACTIONS = ["SwitchOn", "SwitchOff", "PlugIn", "PlugOut", "Walk", "Grab"]
ACTION_EXPR = "CASE k % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " END"
OBJECT_EXPR = "CASE WHEN k % 7 < 3 AND k % 6 = 4 THEN 'kitchen' WHEN k % 7 = 3 AND k % 6 = 4 THEN 'bedroom' ELSE event_type END"
STEPS_SQL = f"""raw AS (SELECT user_id AS script, event_id AS step, event_type, {K} AS k FROM events),
steps AS (SELECT script, step, {ACTION_EXPR} AS action, {OBJECT_EXPR} AS object FROM raw),
fam AS (SELECT *, CASE WHEN action LIKE 'Switch%' THEN 'switch' WHEN action LIKE 'Plug%' THEN 'plug' END AS family FROM steps)"""


def steps(t):
    raw = t.events.select(F.col("user_id").alias("script"), F.col("event_id").alias("step"), "event_type", F.expr(K).alias("k"))
    return raw.selectExpr("script", "step", f"{ACTION_EXPR} AS action", f"{OBJECT_EXPR} AS object")


@query(
    "start_states",
    f"""WITH {STEPS_SQL}, f AS (SELECT script, object, family, min_by(action, step) AS action FROM fam WHERE family IS NOT NULL GROUP BY 1, 2, 3)
SELECT script, object, CASE action WHEN 'SwitchOff' THEN 'is_on' WHEN 'SwitchOn' THEN 'is_off' ELSE 'unplugged' END AS state FROM f WHERE action <> 'PlugOut'""",
)
def start_states(t):
    return graph.start_states(steps(t))


@query(
    "contradictory_steps",
    f"""WITH {STEPS_SQL}, p AS (SELECT *, lag(action) OVER (PARTITION BY script, object, family ORDER BY step) AS was FROM fam WHERE family IS NOT NULL)
SELECT script, object, step, action FROM p WHERE was = action""",
)
def contradictory_steps(t):
    return graph.contradictions(steps(t), 500)


@query(
    "carried_context",
    f"""WITH {STEPS_SQL} SELECT script, step, action, object,
  last_value(CASE WHEN action = 'Walk' AND object IN ('kitchen', 'bedroom') THEN object END IGNORE NULLS) OVER w AS room,
  last_value(CASE WHEN action = 'Walk' AND object NOT IN ('kitchen', 'bedroom') THEN object END IGNORE NULLS) OVER w AS at_reach
FROM steps WINDOW w AS (PARTITION BY script ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def carried_context(t):
    return graph.carried_context(steps(t), ["kitchen", "bedroom"], 500)


@query(
    "perturbed_states",
    f"""WITH {STEPS_SQL}, f AS (SELECT script, object, min_by(action, step) AS action, min(step) AS id FROM fam WHERE family = 'switch' GROUP BY 1, 2),
v AS (SELECT *, unnest(range(1, 4)) AS variant FROM f), u AS (SELECT *, {sql_draw(6, 'id', 'variant')} / 4294967296.0 AS u FROM v)
SELECT script, object, id, CAST(variant AS INT) AS variant, CASE WHEN (action = 'SwitchOff') = (u >= 0.5) THEN 'is_on' ELSE 'is_off' END AS state FROM u WHERE u >= 0.2""",
)
def perturbed_states(t):
    first = steps(t).where("action LIKE 'Switch%'").groupBy("script", "object").agg(F.min_by("action", "step").alias("action"), F.min("step").alias("id"))
    facts = first.select("script", "object", "id", F.when(F.col("action") == "SwitchOff", "is_on").otherwise("is_off").alias("state"))
    return graph.perturb_states(facts, "id", 3, seed=6)
