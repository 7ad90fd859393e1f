"""Loops over rounds: growing samples and filling a table until it holds enough rows."""

import numpy as np
from pyspark.sql import functions as F

from tidewright.operators import jobs, questions
from tidewright.operators.synthesis import array_statistics


def test_table_fills_up_and_resumes(spark, tmp_path):
    path = str(tmp_path / "t")
    made = []

    def make(number):
        made.append(number)
        return spark.range(10)

    assert questions.until_enough(make, path, spark, 25) == (30, "enough")
    assert questions.until_enough(make, path, spark, 25) == (30, "enough") and len(made) == 3


def test_samples_grow_by_unused_fields(spark):
    start = spark.createDataFrame([(1, "q", ["trend"], [])], "sample_id bigint, text string, fields array<string>, history array<string>")
    answer = lambda df: df.withColumn("reply", F.concat("text", F.lit("+"), "field")).withColumn("verdict", F.lit("Valid"))
    rows = questions.evolve(start, answer, rounds=2).collect()
    assert sorted(len(set(r["fields"])) for r in rows) == [1, 2, 3]
    assert max(len(r["history"]) for r in rows) == 2


def test_grown_samples_have_names_of_their_own(spark):
    """Samples 1 and 11, three children a round: every (sample, path) is there once, and draws differ between samples."""
    start = spark.createDataFrame([(i, "q", [], []) for i in (1, 11, 1 << 62)], "sample_id bigint, text string, fields array<string>, history array<string>")
    answer = lambda df: df.withColumn("reply", F.concat("text", F.lit("+"), "field")).withColumn("verdict", F.lit("valid"))
    rows = questions.evolve(start, answer, rounds=2, children=3).collect()
    assert len(rows) == 3 * (1 + 3 + 9) == len({(r.sample_id, tuple(r.path)) for r in rows})
    grown = lambda i: [r.text for r in sorted(rows, key=lambda r: r.path) if r.sample_id == i]
    assert grown(1) != grown(11)


def test_rewriting_goes_on_from_accepted_pairs(spark):
    start = spark.createDataFrame([(i, f"q{i}", "a") for i in range(40)], "sample_id bigint, question string, answer string")
    ask = lambda df: df.withColumns({"new_question": F.concat("question", F.lit("'")), "new_answer": F.when(F.col("sample_id") != 3, F.col("answer"))})
    judge = lambda df: F.when(F.col("sample_id") == 4, "Invalid!").when(F.col("sample_id") == 5, F.lit(None)).otherwise("it is VALID")
    rows = questions.rewrite(start, ask, judge, rounds=2, children=2).collect()
    assert {r.sample_id for r in rows} == set(range(40)) - {3, 4, 5} and len(rows) == 37 * (2 + 4)
    assert all(r.question == f"q{r.sample_id}" + "'" * len(r.path) and len(r.history) == len(r.path) for r in rows)
    assert {r.kind for r in rows} == set(questions.REWRITES)


def groups_by_hand(members, within):
    out, reps = set(), []
    for system, i, p in sorted(members):
        near = [j for s, j, q in reps if s == system and len(q) == len(p) and all(abs(a - b) <= within for a, b in zip(p, q))]
        if p:
            out.add((system, near[0] if near else i, i))
            if not near:
                reps.append((system, i, p))
    return out


def test_similar_groups_equal_a_plain_walk(spark):
    rng = np.random.default_rng(3)
    members = [(int(s), i, sorted(int(x) for x in rng.integers(0, 120, rng.integers(0, 4)))) for i, s in enumerate(rng.integers(0, 3, 300))]
    members += [(7, 1000 + i, [i * 10]) for i in range(40)]  # a chain: neighbours are near, the ends are not
    members += [(8, 2000 + i, [50, 60]) for i in range(200)]
    df = spark.createDataFrame(members, "system int, metric_id int, positions array<int>").repartition(5)
    got = {tuple(r) for r in questions.similar_groups(df).collect()}
    assert got == groups_by_hand(members, 15)


def test_similar_groups_of_small_systems_are_walked_without_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    members = [(int(s), i, sorted(int(x) for x in rng.integers(0, 60, rng.integers(1, 4)))) for i, s in enumerate(rng.integers(0, 40, 400))]
    df = spark.createDataFrame(members, "system int, metric_id int, positions array<int>").repartition(5)
    stored, durable = [], questions.durable

    def counted(frame):
        out = durable(frame)
        stored.append(out.count())
        return out

    monkeypatch.setattr(questions, "durable", counted)
    assert {tuple(r) for r in questions.similar_groups(df).collect()} == groups_by_hand(members, 15)
    assert sum(stored) <= 400  # before: rows of every round, and leaders in 27 cells each


def synthetic(spark, rows):
    schema = "series_id int, system string, series_no int, metric string, seq_len int, trend string, season string, frequency string, period double, noise string, noise_std double, y array<double>, points array<struct<x:double,y:double>>, changes array<struct<no:int,type:string,amplitude:double,position_start:int,position_end:int>>"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("statistics", array_statistics("y"))


def test_captions_tell_trend_and_changes_in_order(spark):
    y = [float(i) for i in range(40)]
    rows = [
        (1, "s", 0, "a", 40, "multiple", "sine wave", "low frequency", 12.5, "noisy", 0.25, y, [(0.0, -1.0), (20.0, 1.0), (39.0, 0.0)], [(0, "upward spike", 2.0, 25, 30), (1, "shake", 1.0, 27, 29)]),
        (2, "s", 1, "b", 40, "increase", "no periodic fluctuation", "no periodicity", 0.0, "almost no noise", 0.0, y, None, []),
    ]
    got = {r.series_id: r.caption for r in questions.captions(synthetic(spark, rows)).collect()}
    first = got[1]
    order = ["At the beginning, from point 0 to point 20 the trend is increase, with values from 0.00 to 20.00", "the trend turns to decrease", "from point 20 to point 25", "a upward spike with an amplitude of 2.00 between point 25 and point 30", "finally, from point 30 to point 39 the trend is decrease"]
    assert [first.index(x) for x in order] == sorted(first.index(x) for x in order) and "shake" not in first
    assert "Each period is approximately 12.5 points" in first and "finally, from point 0 to point 39 the trend is increase" in got[2] and "Each period" not in got[2]


def test_segment_means_have_the_stated_number(spark):
    for n, step in ((100, 3), (64, 2), (40, 2), (31, 1), (1, 1)):
        y = [float(i * i % 17) for i in range(n)]
        got = spark.createDataFrame([(y,)], "y array<double>").select(questions.segment_means("y", 6).alias("m")).first()["m"]
        assert got == [round(float(np.mean(y[i : i + step])), 6) for i in range(0, n, step)]


def test_questions_about_a_system(spark):
    base = [0.0] * 60
    row = lambda s, no, trend, starts: (no, s, no, f"m{no}", 60, trend, "no periodic fluctuation", "no periodicity", 0.0, "almost no noise", 0.0, base, [(0.0, 0.0), (59.0, 1.0)] if trend == "multiple" else None, [(k, "shake", 1.0, p, p + 2) for k, p in enumerate(starts)])
    rows = [row("x", 0, "increase", [10]), row("x", 1, "decrease", [20]), row("x", 2, "increase", [40]), row("x", 3, "multiple", []), row("x", 4, "multiple", [41]), row("y", 0, "increase", [])]
    series = synthetic(spark, rows)
    out = questions.system_questions(series, seed=1).collect()
    mine = [r for r in out if r.system == "x"]
    assert sorted(r.question_no for r in mine) == list(range(len(mine)))
    same = {r.kind: [] for r in mine}
    for r in mine:
        same[r.kind].append(r)
    assert [r.fields["trend"] for r in same["same trend"]] == [[0, 2]] and [r.fields["local"] for r in same["same local"]] == [[0, 1], [2, 4]]
    assert sorted(r.fields["correlation"][0] for k in ("same trend", "same local") for r in same[k]) == [0, 1, 2]
    assert len(same["one"]) == len(same["all"]) == 1 and same["all"][0].answer.count("Time series") == 5
    assert [r.kind for r in out if r.system == "y"] == ["one", "all"]
    required = spark.createDataFrame([("x", "trend", [0, 4]), ("x", "correlation", [0])], "system string, field string, numbers array<int>")
    pool = spark.createDataFrame([("x", 0, "m0, m2: alike.")], "system string, group_no int, answer string")
    told = {r.field: r.context for r in questions.field_contexts(required, series, pool).collect()}
    assert told["trend"].count("In m") == 2 and told["correlation"].endswith("\nm0, m2: alike.")


def test_synthesis_resumes_and_gives_values_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, t, float(np.sin(t * 2 * np.pi / 24) * (2 + i) + rng.normal() * 0.1)) for i, k in enumerate("ab") for t in range(480) if t % 13 or t == 0]
    seen = spark.createDataFrame(rows, "k string, t bigint, value double")
    calls = []

    def make(number, given):
        calls.append(number)
        return given.select((F.col("id") + 1000 * (number + 1)).alias("id"), F.transform("z", lambda v: v * (1 + 0.01 * (number + 1))).alias("z"))

    path = str(tmp_path / "accepted")
    out = jobs.series_synthesis(seen, "k", path, make, 1, min_points=48, most_rounds=2, threshold=0.0)
    first = out.collect()
    assert calls == [0, 1] and {r.channel for r in first} == {"a", "b"} and all(len(r.x) == 48 for r in first)
    again = jobs.series_synthesis(seen, "k", path, make, 1, min_points=48, most_rounds=3, threshold=0.0).collect()
    assert calls == [0, 1, 2] and {(r.round, r.id) for r in first} < {(r.round, r.id) for r in again}
    grown = {(r.channel, r.id % 1000): r.x for r in first if r.round == 0}
    truth = {(k, t): v for k, t, v in rows}
    for (k, w), x in grown.items():  # windows are a day apart; one percent more of the scores changes little
        given = [truth.get((k, w * 24 + i)) for i in range(48)]
        assert np.mean([abs(a - b) for a, b in zip(x, given) if b is not None]) < 0.5
