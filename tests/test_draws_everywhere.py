"""Generated rows don't depend on partitions, and streamed forms agree with batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from tidewright.plans import catalog
from tidewright.streaming import streams

PATH = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
DRAWN = [
    "random_attributes", "metric_groups", "labelled_pairs", "sampled_channels", "clock_times", "numbered_sets", "controlled_series", "correlated_shapes", "series_questions",
]


@pytest.mark.parametrize("name", DRAWN)
def test_rows_are_the_same_over_other_partitions(spark, name):
    got = []
    for partitions, size in (("3", "64m"), ("11", "4k")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append(sorted(map(str, catalog.QUERIES[name](spark, PATH).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1] and got[0]


def test_attributes_keep_their_ranges(spark):
    rows = catalog.QUERIES["random_attributes"](spark, PATH)
    assert rows.where((F.size("change_types") > 3) | (F.col("seq_len") <= 0)).count() == 0


def events(spark, folder):
    rows = [(f"s{i % 3}", i * 5 if i < 40 else 100_000 + i) for i in range(42)]
    df = spark.createDataFrame(rows, "sensor string, second long").withColumn("ts", F.timestamp_seconds("second"))
    df.repartition(1).write.parquet(folder)
    return spark.read.parquet(folder), spark.readStream.schema("sensor string, second long, ts timestamp").parquet(folder)


def streamed(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in query_df.sparkSession.table(name).collect()]


def test_sensor_sessions_streamed(spark, tmp_path):
    batch, stream = events(spark, f"{tmp_path}/events")
    want = {tuple(r) for r in streams.sensor_sessions(batch, "sensor").collect()}
    got = set(streamed(streams.sensor_sessions(stream, "sensor"), "sessions"))
    assert got and got <= want  # sessions that the watermark has not passed stay open


def test_first_arrivals_streamed(spark, tmp_path):
    _, stream = events(spark, f"{tmp_path}/events")
    got = streamed(streams.first_arrivals(stream, ["sensor"], delay="10 days"), "arrivals")
    assert sorted(r[0] for r in got) == ["s0", "s1", "s2"]
