"""File formats, sinks and streams on small folders."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.sources import readers, sinks
from tidewright.streaming import streams


def test_json_lines_split_good_and_bad(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "content": "x"}\n\n{"id": 2, "content": "y"}\nnot json\n')
    rows, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted((r["id"], r["content"]) for r in rows.collect()) == [(1, "x"), (2, "y")]
    assert [r["value"] for r in bad.collect()] == ["not json"]


def test_json_yaml_and_folder(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"key_1": "a"}))
    (tmp_path / "many.json").write_text(json.dumps([{"key_1": "b"}, {"key_2": {"z": 1}}]))
    (tmp_path / "l.jsonl").write_text('{"key_1": "c"}\n')
    (tmp_path / "s.yaml").write_text("- id: 1\n  content: hello\n- id: 2\n")
    assert readers.read_json(spark, str(tmp_path / "*.json")).count() == 3
    assert sorted(r["key_1"] or "" for r in readers.read_folder(spark, str(tmp_path)).collect()) == ["", "a", "b", "c"]
    assert [tuple(r) for r in readers.read_yaml(spark, str(tmp_path / "s.yaml"), "id string, content string").collect()] == [("1", "hello"), ("2", None)]


@pytest.mark.parametrize("bad", ["a: |\n  text", "a:\n  b: 1", "a: [1, 2]", "just words", "- a: 1\n  b:\n    c: 2"])
def test_yaml_that_is_not_flat_fails(spark, tmp_path, bad):
    (tmp_path / "s.yaml").write_text(bad)
    with pytest.raises(Exception, match="is not flat YAML"):
        readers.read_yaml(spark, str(tmp_path / "s.yaml"), "a string").collect()


def test_flat_yaml_values(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# rows\n---\n- id: 1\n  content: 'a: b'  # why\n-\n  id: \"2\"\n  content:\n")
    assert [tuple(r) for r in readers.read_yaml(spark, str(tmp_path / "s.yaml"), "id string, content string").collect()] == [("1", "a: b"), ("2", None)]


def test_lines_of_a_large_file_keep_their_numbers(spark, tmp_path):
    """Ranges of 64 KB over two files; blank lines, two kinds of line ends and wide characters."""
    want = {}
    for name, n in (("a.log", 40_000), ("b.log", 3)):
        lines = ["" if i % 11 == 0 else f"{i} é{'x' * (i % 50)}" for i in range(n)]
        (tmp_path / name).write_bytes("".join(line + ("\r\n" if i % 3 else "\n") for i, line in enumerate(lines)).encode())
        want.update({(name, i): line for i, line in enumerate(lines)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        out = readers.read_lines(spark, str(tmp_path / "*.log"))
        got = out.collect()
        tasks = spark.read.text(str(tmp_path / "*.log")).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks > 10 and len(got) == len(want)
    assert {(r["file"], r["line_no"]): r["text"] for r in got} == want


def test_csv_is_all_strings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id, content\n1, "This is, it"\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), skipinitialspace=True)
    assert got.first().asDict() == {"id": "1", "content": "This is, it"}


def test_activity_log_checks_its_width(spark, tmp_path):
    n = len(readers.ACTIVITY_COLUMNS)
    assert n == 54
    (tmp_path / "a.dat").write_text(" ".join(["1.0", "5", "NaN", *["2.5"] * (n - 3)]) + "\n")
    row = readers.active_rows(readers.read_activity(spark, str(tmp_path / "a.dat")), ["heart_rate", "hand_acc16_x"]).first()
    assert row["heart_rate"] is None and row["hand_acc16_x"] == 2.5
    (tmp_path / "b.dat").write_text("1 2 3\n")
    with pytest.raises(Exception, match="has not 54 columns"):
        readers.read_activity(spark, str(tmp_path / "b.dat")).collect()


def test_motion_log_skips_bad_and_repeated_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 A s1 kitchen 1.0 2.0 3.0\n1 A s1 kitchen 1.0 2.0 3.0\nx A s1 kitchen 1 2 3\n2 A\n3 A s2 bath 0 0 0\n")
    got = readers.read_motion(spark, str(tmp_path / "m.txt")).orderBy("line_no").collect()
    assert [(r["frame"], r["sensor"]) for r in got] == [(1, "A s1"), (3, "A s2")]
    assert readers.read_motion(spark, str(tmp_path / "m.txt"), num_lines=2).count() == 1


def test_primary_must_succeed_secondaries_may_fail(spark, tmp_path):
    def broken(df):
        raise OSError("no disk")

    df = spark.range(3)
    failed = sinks.write_all(df, lambda d: sinks.write_parquet(d, str(tmp_path / "p")), [broken])
    assert len(failed) == 1 and spark.read.parquet(str(tmp_path / "p")).count() == 3
    with pytest.raises(OSError):
        sinks.write_all(df, broken)


def test_a_restarted_stream_goes_on(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    write = streams.split_sinks(F.when(F.col("id") % 2 == 1, "odd"), str(out / "kept"), str(out / "rejected"))
    for number in range(2):
        (src / f"{number}.json").write_text("\n".join(json.dumps({"id": number * 10 + i}) for i in range(4)))
        streams.run_available(streams.resume_files(spark, str(src), "id bigint"), write, str(tmp_path / "ck"))
    kept = sorted(r["id"] for r in spark.read.parquet(str(out / "kept")).select("id").collect())
    assert kept == [0, 2, 10, 12]
    assert spark.read.parquet(str(out / "rejected")).count() == 4


def test_streamed_windows_equal_batch(spark, tmp_path):
    src = tmp_path / "ev"
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(str(src))
    stream = streams.windowed_stats(spark.readStream.schema(rows.schema).parquet(str(src)), "k", "v", "10 minutes")
    seen = []
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, i: seen.append(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = streams.windowed_stats(rows, "k", "v", "10 minutes").collect()
    assert sorted(map(str, seen[-1])) == sorted(map(str, batch))
