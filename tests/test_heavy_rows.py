"""Work that is heavy per row is dealt over the cluster, planned small and linear in the length of a row."""

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.functions import rouge, scoring
from tidewright.functions.draws import Draws
from tidewright.operators import greedy, similarity, synthesis
from tidewright.plans import relational_queries


def test_series_of_one_small_file_use_every_core(spark):
    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("series_id"), F.lit(30).alias("seq_len"))
    made = synthesis.synthesise(synthesis.random_attributes(rows), id="series_id")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert made.select("series_id").distinct().count() == 40


def test_a_change_is_planned_once_for_all_types(spark):
    phases, after = synthesis._phases(Draws(1, "series_id"), F.element_at(synthesis._table(), F.col("kind")), F.col("seq_len"), 0)
    rows = spark.createDataFrame([(i, 128, name) for i, name in enumerate(synthesis.SHAPES)], "series_id long, seq_len int, kind string")
    df = rows.select("kind", phases.alias("ph"), after.alias("after"))
    assert df._jdf.queryExecution().analyzed().toString().count("xxhash64") < 60
    got = {r.kind: r for r in df.collect()}
    assert len(got["shake"].ph) == 1 and len(got["continuous upward spike"].ph) == 20 and len(got["sudden increase"].ph) == 2
    assert got["sudden decrease"].after < 0 < got["sudden increase"].after
    assert got["upward spike"].ph[0].rise == 1.0 and got["downward spike"].ph[0].rise == -1.0


def test_statistics_of_a_row_are_linear_in_its_length(spark):
    values = np.random.default_rng(1).normal(size=20000)
    df = spark.createDataFrame([(values.tolist(),)], "y array<double>")
    begun = time.time()
    got = df.select(synthesis.array_statistics("y").alias("s")).first().s
    assert time.time() - begun < 60  # a mean at every point takes 800 million steps
    assert abs(got["mean"] - values.mean()) < 0.0051 and abs(got["std"] - values.std()) < 0.0051


def test_containers_count_candidates_other_than_themselves(spark):
    rows = [(1, 1, "A", "F"), (1, 2, "A", "F"), (2, 2, "N", "O"), (7, 2, "A", "F"), (7, 2, "N", "O"), (9, 9, "Z", "F")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    out = relational_queries.replacement_containers(SimpleNamespace(lineitem=lines))
    got = {r.id: (r.wants, r.candidates, r.first_candidate) for r in out.where("part = 'container'").collect()}
    assert got == {1: ("AF", 1, 2), 2: ("NO", 0, None), 7: ("AF,NO", 1, 2), 9: ("ZF", 0, None)}
    assert {(r.id, r.wants) for r in out.where("part = 'candidate'").collect()} == {(1, "AF"), (2, "AF"), (2, "NO"), (2, "AF,NO"), (9, "ZF")}


def test_facts_of_an_answer_are_read_once(spark):
    rows = spark.createDataFrame([("An upward spike, around point 9, with an amplitude of 4; a shake, around point 200", 10.0)], "a string, p double")
    feature = lambda name: F.struct(F.array(F.lit(name)).alias("types"), F.col("p").alias("position"), F.lit(4.0).alias("amplitude"))
    out = rows.select(scoring.local_explained(F.col("a"), F.array(feature("upward spike"), feature("shake")), F.array(F.lit(0.5), F.lit(0.5))).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp") <= 2
    got = out.first().s
    assert got["categorical"] == [1.0, 0.0] and got["reason"] == [0.5, 0.0]
    assert got["numerical"][1] == 1.0 and 0 < got["numerical"][0] < 1 and got["numerical"][2:] == [0.0, 0.0]


def _copies_and_strangers(seed, n):
    """Texts over few words, every third a near copy of an earlier one."""
    rng, texts = np.random.RandomState(seed), []
    for i in range(n):
        if i % 3 == 2:
            words = list(texts[rng.randint(len(texts))])
            for _ in range(rng.randint(1, max(2, len(words) // 4))):
                words[rng.randint(len(words))] = f"w{rng.randint(60)}"
        else:
            words = [f"w{x}" for x in rng.zipf(1.3, rng.choice([2, 3, 6, 40, 90])) % 60]
        texts.append(words)
    return texts


@pytest.mark.parametrize("threshold,types,filtering", [(0.8, ("lcs",), True), (0.8, ("lcs",), False), (0.7, ("lcs",), True), (0.8, ("n_1",), False)])
def test_near_copies_of_long_and_short_texts_are_found(spark, threshold, types, filtering):
    texts = _copies_and_strangers(3, 120)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.is_valid for r in similarity.similarity_dedup(docs, None, threshold, types, filter_invalids=filtering).collect()}
    before, want = [], {}
    for i, t in enumerate(texts):
        want[i] = all(rouge.similarity(t, x, types) < threshold for x in before)
        if want[i] or not filtering:
            before.append(t)
    assert got == want


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_lists_carry_numbers_and_strangers_do_not_meet(spark, threshold):
    rng = np.random.RandomState(5)
    texts = [[f"w{x}" for x in rng.randint(0, 300, 90)] for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + [texts[7][:-3]])), "r long, tokens array<string>")
    for way, entries in similarity.token_lists(docs, threshold, ("lcs",), "f1").items():
        assert not {"string", "array<string>"} & {kind for _, kind in entries.dtypes}
        spots = entries.withColumn("_led", F.lit(True))
        met = similarity._meetings(way, spots, spots, threshold, F.col("r") < F.col("_lr")).collect()
        assert [(r.low, r.high) for r in met] in ([(7, 80)], [])
        assert met or threshold == 0.8


def test_context_texts_draw_no_documents_into_one_task(spark, monkeypatch):
    plans = []
    kept = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    docs = spark.createDataFrame([(i, f"the a{i} b{i % 3} c".split()) for i in range(30)], "id long, tokens array<string>")
    context = spark.createDataFrame([("the b1 c".split(),), ("the a7 x".split(),)], "tokens array<string>")
    got = {r.id: r.score for r in similarity.context_scores(docs, context).collect()}
    assert abs(got[1] - 6 / 7) < 1e-12 and abs(got[0] - 4 / 7) < 1e-12
    assert plans and not any("SortMergeJoin [cid" in p or "SortMergeJoin [kind" in p for p in plans)


@pytest.mark.parametrize("score", rouge.SCORES)
def test_subsequences_with_all_texts_of_a_pack_at_once(monkeypatch, score):
    rng = np.random.default_rng(7)
    texts = [[f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 90))] for _ in range(20)]
    docs = [[f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 120))] for _ in range(30)] + [None, [], ["other"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.string()))], names=["id", "tokens"])
    want = [max(rouge.similarity(d, t, ("lcs",), score) for t in texts) if d else 0.0 for d in docs]
    for bits in (1, 200, 8192):
        monkeypatch.setattr(rouge, "PACK_BITS", bits)
        got = [x for part in rouge.best_subsequences(texts, score)([batch.slice(0, 7), batch.slice(7)]) for x in part.column(1).to_pylist()]
        assert got == want


def test_documents_meet_a_small_context_where_they_are_read(spark, monkeypatch):
    written = []
    kept = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: written.append(df.columns) or kept(df))
    docs = spark.createDataFrame([(1, "a b c d".split()), (2, None), (3, []), (4, "x".split()), (1, "a b".split())], "id long, tokens array<string>")
    context = spark.createDataFrame([("a c d e".split(),), (None,), ([],), ("a b".split(),)], "tokens array<string>")
    out = similarity.context_scores(docs, context)
    assert sorted((r.id, round(r.score, 9)) for r in out.collect()) == [(1, 1.0), (1, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]
    assert written == [["tokens"]]  # the texts of the context alone, no pairs


@pytest.mark.parametrize("threshold,types,score,filtering", [(0.8, ("lcs",), "f1", True), (0.7, ("lcs",), "f1", False), (0.6, ("lcs", "n_2"), "f1", True), (0.9, ("n_1",), "recall", True)])
def test_greedy_dedup_goes_piece_by_piece_without_lists(spark, monkeypatch, threshold, types, score, filtering):
    written = []
    kept = similarity.durable
    monkeypatch.setattr(similarity, "durable", lambda df: written.append(df) or kept(df))
    monkeypatch.setattr(greedy, "PIECE_TOKENS", 900, raising=False)
    monkeypatch.setattr(greedy, "SOME", 2, raising=False)
    rng = np.random.default_rng(4)
    texts = _copies_and_strangers(9, 70)
    texts += [[w if rng.random() > 0.08 else f"w{rng.integers(60)}" for w in texts[4]] for _ in range(20)]  # a group of near copies
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(500, None), (501, "..."), (3, " ".join(texts[3]))], "id long, text string")
    got = {r.id: r.is_valid for r in similarity.similarity_dedup(docs, None, threshold, types, score, filter_invalids=filtering).collect()}
    before, want = [], {500: False, 501: True}
    for i, t in enumerate(texts):
        want[i] = all(rouge.similarity(t, x, types, score) < threshold for x in before)
        if want[i] or not filtering:
            before.append(t)
    assert got == want
    assert not any({"item", "tokens"} & set(df.columns) for df in written)


def test_greedy_dedup_with_a_context(spark):
    texts = ["a b c d e f", "a b c d e g", "x y z", "p q r s", "p q r s", None, "", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    context = spark.createDataFrame([("x y z w",), ("a b k l",)], "text string")
    got = {r.id: (round(r.context_score, 6), r.is_valid) for r in similarity.similarity_dedup(docs, context, 0.8).collect()}
    assert got == {0: (0.4, True), 1: (0.4, False), 2: (0.857143, False), 3: (0.0, True), 4: (0.0, False), 6: (0.0, True), 7: (0.666667, True)}
