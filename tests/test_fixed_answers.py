"""Answers that tables and SQL don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.functions import encoding, text, toolcalls
from tidewright.functions.draws import Draws
from tidewright.operators import evaluation, intervals, matrix, relational, series, synthesis
from tidewright.sources import readers
from tidewright.streaming import streams

TOOLS = [("find", ["to"], {"to": "array", "day": "string", "n": "integer", "from": "object", "yes": "boolean"})]


def reasons(spark, cases, **options):
    rows = [(i, json.dumps(calls), question, TOOLS) for i, (calls, question) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id long, answer string, question string, tools array<struct<name:string,required:array<string>,types:map<string,string>>>")
    return [r.reason for r in toolcalls.check_calls(df, **options).orderBy("id").collect()]


def test_argument_values_against_the_question(spark):
    call = lambda **a: [{"name": "find", "arguments": {"to": [], **a}}]
    said = "argument value not in question"
    assert reasons(spark, [
        (call(to=["Paris", "Rome"]), "Flights from Rome to Paris"),
        (call(to=["Paris", "Oslo"]), "Flights from Rome to Paris"),
        (call(day="tin"), "When does the show start in town?"),
        (call(n=3), "three tickets please"),
        (call(n=12), "twelve tickets please"),
        (call(**{"from": {"city": "Rome", "stops": ["Bari"]}}), "by way of bari, from ROME!"),
        (call(**{"from": {"Rome": "Turin"}}), "from Rome"),
        (call(day="2024-05-06"), "on the sixth of May"),
        (call(yes=True), "anything"),
    ]) == [None, said, said, None, said, None, said, said, None]
    assert reasons(spark, [(call(day="2024-05-06"), "on the sixth"), (call(day="May 6, 2024"), "x"), (call(day="soon"), "x")], ignore_types=("boolean", "date")) == [None, None, said]


def test_later_and_nested_references(spark):
    calls = [{"name": "find", "id": "a", "arguments": {"to": []}}, {"name": "find", "id": "b", "arguments": {"to": [], "day": "a.out"}}]
    assert reasons(spark, [(calls, "x")]) == ["nested reference"]
    assert reasons(spark, [(calls, "x")], allow_nested=True) == [None]
    assert reasons(spark, [(calls[::-1], "x")], allow_nested=True) == ["future reference"]


def test_python_literals(spark):
    cases = {"{'a': \"it's\"}": {"a": "it's"}, "('x',)": ["x"], "{'k': None, 'b': [True, False]}": {"k": None, "b": [True, False]}, "['say \"hi\"', 'it\\'s']": ['say "hi"', "it's"], '{"True": "None (x)"}': {"True": "None (x)"}, "no": None, "{'a': 1": None}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", F.to_json(text.tolerant_json("t")).alias("j")).collect()
    assert {r.t: None if r.j is None else json.loads(r.j) for r in rows} == cases


def test_blank_lines_are_no_wrong_lines(spark):
    lines = spark.createDataFrame([("f", 0, "[walk] <bed>", "walk", ["bed"], "bedroom"), ("f", 1, "", "", [], None), ("f", 2, "  ", "", [], None)], "file string, line_no long, text string, action string, objects array<string>, room string")
    r = evaluation.format_report(lines, spark.createDataFrame([("bedroom", "bed")], "room string, object string")).first()
    assert (r.total_lines, r.wrong_lines, r.unknown_actions) == (1, 0, 0)


def test_activity_columns():
    names = readers.ACTIVITY_COLUMNS
    assert len(names) == len(set(names)) == 54 and names[3] == "hand_temp" and names[16] == "hand_orient_0" and names[-1] == "ankle_orient_3"


def test_retried_batch_is_stored_once(spark, tmp_path):
    write = streams.split_sinks(F.when(F.col("id") % 2 == 0, "even"), f"{tmp_path}/kept", f"{tmp_path}/rejected")
    for _ in range(2):
        write(spark.range(10), 7)
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 5 and spark.read.parquet(f"{tmp_path}/rejected").count() == 5


def test_filled_scores_keep_every_row(spark):
    full = spark.createDataFrame([("c", w, [1.0, 2.0, 3.0]) for w in (5, 1000, 20_000_000)], "channel string, window long, z array<double>")
    made = spark.createDataFrame([("c", w, [9.0]) for w in range(50)], "channel string, window long, z array<double>")
    out = matrix.fill_scores(made, full, seed=3).collect()
    assert len(out) == 50 and all(r.z == [1.0, 2.0, 9.0] for r in out)


def test_every_change_gets_its_turn(spark):
    kinds = ["upward spike"] * 7
    rows = spark.createDataFrame([(1, 4000, 10.0, kinds, [i * 500 for i in range(7)])], "series_id long, seq_len int, overall_amplitude double, change_types array<string>, change_positions array<int>")
    out = synthesis.with_changes(rows, Draws(1, "series_id")).first()
    assert [c.position_start for c in out.changes] == [i * 500 for i in range(7)]
    none = synthesis.with_changes(rows.withColumn("change_types", F.array().cast("array<string>")), Draws(1, "series_id")).first()
    assert none.changes == []


@pytest.mark.parametrize("split", ["no-periodicity", "maximize-overlap", "minimize-overlap"])
def test_windows_of_series_of_any_length(spark, split):
    """Window starts against the rules written as loops, for several lengths at once."""

    def starts(n, period, length, wanted):
        last = n - length
        if split == "no-periodicity":
            return [0] if wanted <= 1 or last <= 0 else [i * (last // (wanted - 1)) for i in range(wanted)]
        if split == "maximize-overlap":
            return list(range(0, last + 1, period))
        if n // length >= wanted:
            step = max(1, length // period) * period
            out = list(range(0, last + 1, step))
        else:
            step = max(1, max(1, -(-last // (wanted - 1))) // period) * period
            out = [min(i * step, max(0, last)) for i in range(wanted)]
        covered = length + (len(out) - 1) * step
        return out + [covered + (n - covered) // period * period - length] if n - covered > period else out

    lengths = [20, 21, 37, 64, 150, 401]
    rows = spark.createDataFrame([(n, t, float(t)) for n in lengths for t in range(n)], "key int, t long, value double")
    for period, wanted in ((5, 4), (24, 3)):
        got = {tuple(r) for r in series.cut_windows(rows, ["key"], None, period, 20, wanted, split).select("key", "window", "pos", "value").collect()}
        assert got == {(n, w, p, float(s + p)) for n in lengths for w, s in enumerate(starts(n, period, 20, wanted)) for p in range(20) if 0 <= s + p < n}


def test_paths_into_arrays(spark):
    rows = spark.createDataFrame([(1, [("x", 1)])], "id int, a array<struct<s:string,n:int>>")
    out = relational.set_path(relational.set_path(rows, "a[0].n", F.lit(7)), "a[2].s", F.lit("new")).first()
    assert [None if i is None else tuple(i) for i in out.a] == [("x", 7), None, ("new", None)]
    out = relational.set_path(rows, "b[1].c.d", F.lit(3)).first()
    assert out.b[0] is None and out.b[1].c.d == 3


def test_templates_and_orders(spark):
    rows = spark.range(40).withColumn("x", F.col("id") / 4).withColumn("y", F.col("id") * 2.0)
    first = rows.select(text.render({"q": "Is {{x}}?", "a": "{{ id }}"}).alias("r")).orderBy("r.a").first().r
    assert first.asDict() == {"q": "Is 0.0?", "a": "0"}
    said = [r[0] for r in rows.select(encoding.row_to_text(["x", "y"], shuffle_by="id")).collect()]
    starts = {s.split(" is")[0] for s in said}
    assert starts == {"Input: x", "Input: y"}
    i = next(i for i, s in enumerate(said) if s.startswith("Input: y"))
    assert said[i] == f"Input: y is [blank], x is [blank] [sep] Target: {i * 2.0:.4f} [answer] {i / 4:.4f} [answer]"


def test_frame_numbers(spark):
    names = spark.createDataFrame([("Action_0_0012_normal_0007.png",), ("clip12",), ("none.txt",)], "n string")
    assert [r[0] for r in names.select(intervals.frame_of("n")).collect()] == [7, 12, None]


def test_active_rows_are_interpolated(spark):
    log = spark.createDataFrame([(0.0, 1, None), (1.0, 0, 50.0), (2.0, 1, 1.0), (3.0, 2, None), (20_000.0, 2, None), (40_000.0, 1, 4.0), (40_001.0, 1, None)], "timestamp double, activity_id int, c double")
    out = readers.active_rows(log, ["c"], 6, interpolate=True).orderBy("timestamp").collect()
    assert [r.c for r in out] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    with pytest.raises(ValueError):
        readers.active_rows(log, ["c"], 7)


def test_folders_one_level_down(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n')
    (tmp_path / "sub" / "b.jsonl").write_text('{"k": 2}\n')
    assert readers.read_folder(spark, str(tmp_path), ["jsonl"], "*/*").count() == 1
    assert readers.read_folder(spark, str(tmp_path), ["jsonl"], "{,*/}*").count() == 2
