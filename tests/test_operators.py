"""Properties and small golden cases of operators that SQL cannot state, or where borders matter."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.functions import encoding, rouge, scoring, tags, text
from tidewright.functions.draws import Draws, uniform
from tidewright.operators import graph, intervals, matrix, neighbours, relational, series, similarity
from tidewright.operators.scan import chunk_of, islands, scan


def test_scan_is_the_same_for_every_chunk_size(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, t * 1.0]), rng.randint(0, 1)) for k in range(3) for t in range(57)]
    df = spark.createDataFrame(rows, "k int, t int, v double, f int")
    out = []
    for size in (1, 7, 1000):
        got = scan(df, ["k"], "t", chunk_of("t", size), lag={"p": "v"}, lead={"q": "v"}, last={"a": "v"}, next={"b": "v"}, cumsum={"s": "f"})
        out.append(got.toPandas().sort_values(["k", "t"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(out[0], out[2])
    pd.testing.assert_frame_equal(out[1], out[2])
    base = pd.DataFrame(rows, columns=["k", "t", "v", "f"])
    g = base.groupby("k")
    pd.testing.assert_series_equal(out[0]["s"], g["f"].cumsum().rename("s"), check_dtype=False)
    pd.testing.assert_series_equal(out[0]["a"], g["v"].ffill().rename("a"))
    pd.testing.assert_series_equal(out[0]["b"], g["v"].bfill().rename("b"))
    pd.testing.assert_series_equal(out[0]["p"], g["v"].shift(1).rename("p"))


def test_islands_number_runs_across_chunks(spark):
    frames = [1, 2, 5, 30, 31, 60, 79, 80, 200]
    df = spark.createDataFrame([("a", f) for f in frames], "s string, f int")
    for size in (3, 50, 1000):
        got = islands(df, ["s"], "f", chunk_of("f", size), "f", lambda p, c: c - p >= 20).orderBy("f").collect()
        assert [r["run_id"] for r in got] == [1, 1, 1, 2, 2, 3, 3, 3, 4]


def test_off_comes_one_frame_after_the_last(spark):
    rows = [("m", f, 1.0, 0.0, 0.0) for f in (1, 5, 40)] + [("m", 10, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "sensor string, frame int, x double, y double, z double")
    got = intervals.transitions(intervals.active_intervals(df, ["sensor"]), ["sensor"]).collect()
    assert sorted((r["frame"], r["state"]) for r in got) == [(1, "ON"), (6, "OFF"), (40, "ON"), (41, "OFF")]


def test_autocorrelation_blocks_agree(spark):
    y = np.sin(np.arange(300) / 5.0)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "s string, t int, value double")
    one = series.autocorrelation(df, ["s"], max_lag=40).orderBy("lag").toPandas()["acf"].to_numpy()
    many = series.autocorrelation(df, ["s"], max_lag=40, block_rows=45).orderBy("lag").toPandas()["acf"].to_numpy()
    d = y - y.mean()
    want = np.array([(d[:-k] * d[k:]).sum() / (d * d).sum() for k in range(1, 41)])
    assert np.allclose(one, want) and np.allclose(many, want)


def test_window_starts_by_split(spark):
    def starts(n, period, length, wanted, split):
        plan = series.window_plan(F.lit(n), period, length, wanted, split)
        r = spark.range(1).select(*[c.alias(k) for k, c in plan.items()]).first().asDict()
        return [min(i * r["step"], r["top"]) for i in range(r["count"])] + ([] if r["extra"] is None else [r["extra"]])

    assert starts(700, 24, 200, 5, "no-periodicity") == [0, 125, 250, 375, 500]
    assert starts(700, 24, 200, 3, "minimize-overlap") == [0, 192, 384, 480]
    assert len(starts(100, 90, 40, 10, "minimize-overlap")) >= 10  # period above the window must end


def _greedy(rows, threshold, keep_only):
    kept, seen, verdict = [], [], {}
    for key, tokens in rows:
        others = kept if keep_only else seen
        ok = all(rouge.similarity(tokens, o) < threshold for o in others)
        verdict[key] = ok
        seen.append(tokens)
        if ok:
            kept.append(tokens)
    return verdict


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9, 1.0])
@pytest.mark.parametrize("filtering", [True, False])
def test_similarity_dedup_equals_brute_force(spark, threshold, filtering):
    rng = random.Random(int(threshold * 10))
    shared = [f"w{i}" for i in range(8)]
    texts = []
    for _ in range(60):
        own = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))]
        cut = rng.randint(0, len(own))
        texts.append(own[:cut] + (shared if rng.random() < 0.5 else []) + own[cut:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id bigint, text string")
    got = {r["id"]: r["is_valid"] for r in similarity.similarity_dedup(docs, None, threshold, filter_invalids=filtering).collect()}
    assert got == _greedy(list(enumerate(texts)), threshold, filtering)


def test_dedup_thresholds_at_the_ends(spark):
    docs = spark.createDataFrame([(1, "I went to the store"), (2, "I went to the store"), (3, "a very other text")], "id bigint, text string")
    verdict = lambda th: [r["is_valid"] for r in similarity.similarity_dedup(docs, None, th).orderBy("id").collect()]
    assert verdict(None) == [True, True, True]
    assert verdict(1.0) == [True, False, True]
    assert verdict(0.0) == [True, False, False]


def test_lcs_is_exact():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 15))] for _ in range(2))
        assert rouge.lcs_length(a, b) == slow(a, b)
    assert rouge.similarity("z a b c".split(), "a b c z".split()) == 0.75


def test_duplicate_summary_with_copies_and_small_blocks(spark):
    rng = np.random.RandomState(0)
    base = rng.normal(size=(30, 6))
    rows = [(i, [float(x) for x in base[i % 10 if i < 20 else i] + (0.01 if 10 <= i < 15 else 0.0)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r["id"]: r for r in neighbours.duplicate_summary(df, "id", "v", 0.05, pivots=4, block=3).collect()}
    x = np.array([r[1] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(30):
        others = np.delete(np.arange(30), i)
        near = [j for j in others if d[i, j] < 0.05]
        assert abs(got[i]["min_distance"] - d[i, others].min()) < 1e-9
        assert got[i]["repeat_count"] == len(near)
        assert got[i]["min_similar_id"] == (min(min(near), i) if near else None)


def test_neighbours_of_even_vectors_travel_a_bounded_number_of_times(spark, monkeypatch):
    x = np.random.RandomState(2).normal(size=(600, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    stored, durable = [], neighbours.durable

    def counted(frame):
        out = durable(frame)
        stored.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "durable", counted)
    got = {}
    for r in neighbours.top_k(df, "id", "v", 3, block=100).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert {i: [n[r] for r in (1, 2, 3)] for i, n in got.items()} == {i: list(d[i].argsort()[:3]) for i in range(600)}
    assert sum(stored) <= 4 * 600  # a stored row a vector and step, not one a ball that it may reach


def test_components_rebuild_windows(spark):
    x = np.random.RandomState(1).normal(size=(25, 8))
    df = spark.createDataFrame([("c", i, [float(v) for v in r]) for i, r in enumerate(x)], 'channel string, `window` bigint, x array<double>')
    parts = matrix.components(matrix.gram(df.repartition(7)))
    lead = matrix.basis(parts, matrix.embedding_sizes(parts, dim=8))
    back = matrix.rebuild(matrix.embed(df, lead), lead).orderBy("window").toPandas()["x"]
    assert np.allclose(np.stack(back.to_numpy()), x)


def test_text_goldens(spark):
    one = spark.createDataFrame([("q1 [Answer] a1 [End] [Question] q2 [Answer] a2 [END] [Question] q3 [Answer] a3",)], "r string")
    got = [(r["question"], r["answer"]) for r in text.explode_qa(one, "r").collect()]
    assert got == [("q1", "a1"), ("q2", "a2")]
    row = spark.range(1).select(
        text.sentences(F.lit("Mr. A is 3.5 high, max. 4. Done!")).alias("s"),
        text.numbered_answers(F.lit("1. one 2. two 3. three"), F.lit(3)).alias("inline"),
        text.numbered_answers(F.lit("nothing"), F.lit(2)).alias("none"),
        text.first_braces(F.lit("x {a {b} c} {d}")).alias("b"),
    ).first()
    assert row["s"] == ["Mr. A is 3.5 high", "max. 4", "Done"]
    assert [a.strip() for a in row["inline"]] == ["one", "two", "three"] and row["none"] == ["", ""]
    assert row["b"] == "{a {b} c}"


def test_generated_text_rows(spark):
    df = spark.createDataFrame([("Input: a is [blank], b is [blank] [sep] Target: 1.5 [answer] x [answer]",), ("broken",), ("Input: a is [blank], b is [blank] [sep] Target: 2 [answer]",)], "t string")
    got = [(r["a"], r["b"]) for r in encoding.text_to_row(df, "t", ["a", "b"]).collect()]
    assert got == [(1.5, None), (None, None)]


def test_tag_salvage(spark):
    said = ['{"difficulty": "very hard"}', '```json\n{"difficulty": "easy"}\n```', '"difficulty": "medium" so', "none"]
    df = spark.createDataFrame([(s,) for s in said], "r string")
    assert [r["tag"] for r in tags.parse_tag(df, "r", "difficulty").collect()] == ["very hard", "easy", "medium", "None"]


def test_local_score_needs_a_near_position(spark):
    feature = F.array(F.struct(F.array(F.lit("upward spike")).alias("types"), F.lit(100.0).alias("position"), F.lit(2.0).alias("amplitude")))
    score = lambda s: spark.range(1).select(scoring.local(F.lit(s), feature).alias("s")).first()["s"]
    near = score("an upward spike, position around point 90, amplitude 2.5")
    assert near["categorical"] == [1.0] and abs(near["numerical"][0] - 0.9) < 1e-9 and abs(near["numerical"][1] - 0.75) < 1e-9
    assert score("an upward spike, position 300, amplitude 2")["categorical"] == [0.0]


def test_draws_do_not_depend_on_partitions(spark):
    d = Draws(3, "id")
    pick = lambda df: {r["id"]: (r["u"], r["v"]) for r in df.select("id", uniform(1, F.col("id")).alias("u"), d.uniform("x").alias("v")).collect()}
    one, many = pick(spark.range(500).repartition(1)), pick(spark.range(500).repartition(8))
    assert one == many
    assert 0.4 < sum(u for u, _ in one.values()) / 500 < 0.6


def test_nearest_in_crowded_cells_forms_few_pairs(spark):
    rng = np.random.RandomState(6)
    places = rng.uniform(0, 8, (4000, 3))  # all in one cell of the given width
    o = spark.createDataFrame([(i, "c", *map(float, p)) for i, p in enumerate(places)], "id bigint, k string, x double, y double, z double")
    asked = rng.uniform(-1, 9, (300, 3))
    p = spark.createDataFrame([(i, "c", *map(float, r)) for i, r in enumerate(asked)], "pid bigint, k string, x double, y double, z double")
    got = {r["pid"]: r["nearest_id"] for r in graph.nearest(p, o, ["k"], "pid", 8.0).collect()}
    d = ((asked[:, None] - places[None]) ** 2).sum(-1)
    assert [got[i] for i in range(300)] == list(d.argmin(1))
    assert graph._widths(o, ["k"], 8.0).first()["_w"] <= 2.0


def test_nearest_matches_brute_force(spark):
    rng = np.random.RandomState(5)
    objects = [(i, "c", *map(float, rng.uniform(0, 50, 3))) for i in range(80)]
    points = [(i, "c", *map(float, rng.uniform(-20, 70, 3))) for i in range(30)] + [(99, "other", 0.0, 0.0, 0.0)]
    o = spark.createDataFrame(objects, "id bigint, k string, x double, y double, z double")
    p = spark.createDataFrame(points, "pid bigint, k string, x double, y double, z double")
    got = {r["pid"]: r["nearest_id"] for r in graph.nearest(p, o, ["k"], "pid", 10.0).collect()}
    for pid, k, *xyz in points:
        want = min(objects, key=lambda r: sum((a - b) ** 2 for a, b in zip(r[2:], xyz)))[0] if k == "c" else -1
        assert got[pid] == want


def test_nearest_far_from_all_cells(spark):
    """Points whose neighbouring cells are empty descend the cells' summary, on both sides of the origin; ties go to the lowest id."""
    rng = np.random.RandomState(6)
    objects = [(i, "c", *map(float, rng.normal(size=3) * 10 ** rng.uniform(0, 4))) for i in range(120)] + [(500, "t", 5.0, 0.0, 0.0), (400, "t", -5.0, 0.0, 0.0)]
    points = [(i, "c", *map(float, rng.normal(size=3) * 10 ** rng.uniform(0, 5))) for i in range(60)] + [(99, "t", 0.0, 0.0, 0.0)]
    o = spark.createDataFrame(objects, "id bigint, k string, x double, y double, z double")
    p = spark.createDataFrame(points, "pid bigint, k string, x double, y double, z double")
    for cell in (0.5, 30.0):
        got = {r["pid"]: (r["nearest_id"], r["distance"]) for r in graph.nearest(p, o, ["k"], "pid", cell).collect()}
        for pid, k, *xyz in points:
            d, want = min((sum((a - b) ** 2 for a, b in zip(r[2:], xyz)), r[0]) for r in objects if r[1] == k)
            assert got[pid][0] == want and abs(got[pid][1] - d**0.5) < 1e-6


@pytest.mark.parametrize("types,score", [(("lcs",), "f1"), (("lcs", "n_2"), "f1"), (("n_1",), "recall"), (("n_1", "n_3"), "precision"), (("n_2",), "f1")])
def test_context_scores_equal_brute_force(spark, types, score):
    rng = np.random.RandomState(7)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 90]
    texts = [words[i * 17 : i * 17 + int(n)] for i, n in enumerate(rng.randint(0, 25, 60))]
    context = [words[i * 31 + 5 : i * 31 + 5 + int(n)] for i, n in enumerate(rng.randint(0, 30, 40))] + [texts[3], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, tokens array<string>")
    ctx = spark.createDataFrame([(c,) for c in context], "tokens array<string>")
    for tail in (False, True):
        got = {r["id"]: r["score"] for r in similarity.context_scores(docs, ctx, types, score, exact_tail=tail).collect()}
        for i, t in enumerate(texts):
            want = max(rouge.similarity(t, c, types, score, tail) for c in context)
            assert abs(got[i] - want) < 1e-12


def test_field_copies_read_the_old_row(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "field1 int, field2 int, field3 int, field4 int")
    got = relational.copy_fields(df, {"field1": "field2", "field3": "field4", "field2": "field3"}).first()
    assert tuple(got) == (1, 1, 2, 3)
