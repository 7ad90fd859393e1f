"""Sensor intervals as data arrives equal those of the batch, also after a restart."""

from pyspark.sql import functions as F

from tidewright.operators import intervals
from tidewright.streaming import streams

SCHEMA = "sensor string, frame bigint, x double, y double, z double"


def test_streamed_intervals_equal_batch(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    frames = {"a": [1, 2, 5, 24, 25, 60, 61, 200, 219, 400], "b": [3, 22, 41, 150], "c": [7]}
    rows = [(s, f, 1.0, 0.0, 0.0) for s, fs in frames.items() for f in fs] + [("a", 10, 0.0, 0.0, 0.0), ("a", 5, 2.0, 0.0, 0.0)]
    # rows of a batch come in any order, and frame 24 comes a batch late
    batches = [[r for r in rows if r[1] < 50 and r[1] != 24][::-1], [r for r in rows if 50 <= r[1] < 160 or r[1] == 24], [r for r in rows if r[1] >= 160], [("end", 9000, 1.0, 0.0, 0.0)], [("end", 9001, 1.0, 0.0, 0.0)]]
    write = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")
    for number, batch in enumerate(batches):  # every round is a restarted query over one more file
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(source / f"n={number}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source / "*"))
        found = streams.sensor_intervals(stream, "sensor", late_frames=60)
        streams.run_available(found, write, str(tmp_path / "ck"))
    got = {(r.sensor, r.run_id, r.start, r["last"]) for r in spark.read.parquet(out).collect()}
    batch = intervals.active_intervals(spark.createDataFrame(rows, SCHEMA), ["sensor"])
    assert got == {(r.sensor, r.run_id, r.start, r["last"]) for r in batch.collect()}


def test_flatten_numbers_run_on_over_a_partition(spark):
    from tidewright.operators import relational

    relational.register_flatten(spark)
    df = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, []), ("k", 3, None), ("k", 4, ["c"]), ("m", 1, ["d"])], "k string, o int, v array<string>")
    got = spark.sql("SELECT * FROM flatten_rows(TABLE({df}) PARTITION BY k ORDER BY (o), 'v')", df=df).collect()
    assert sorted((r.k, r.element_no, r.v) for r in got) == [("k", 1, "a"), ("k", 2, "b"), ("k", 3, "c"), ("m", 1, "d")]
    assert df.select(F.explode("v")).count() == 4
