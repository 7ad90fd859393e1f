"""Incremental forms: resumable reading, ON/OFF intervals, repeat removal, two-way sinks, windowed statistics."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.operators.intervals import magnitude


def resume_files(spark: SparkSession, path: str, schema, fmt="json", files_per_batch=1) -> DataFrame:
    """A file stream; with a checkpoint folder a restarted query goes on after the last finished file."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def run_available(stream: DataFrame, write_batch, checkpoint: str) -> None:
    """Process everything that is there through ``write_batch(df, batch_id)``, then stop."""
    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def split_sinks(reason, kept_path: str, rejected_path: str):
    """A batch writer: valid rows go to one table, the rest with their reason to another; a retried batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        judged = df.withColumn("reason", reason).persist()
        judged.where("reason IS NULL").drop("reason").write.mode("overwrite").parquet(f"{kept_path}/batch={batch_id}")
        judged.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")
        judged.unpersist()

    return write


def sensor_sessions(events: DataFrame, key: str, ts="ts", gap="20 seconds", delay="1 minute") -> DataFrame:
    """ON/OFF intervals per sensor as data arrives: a pause of ``gap`` closes an interval."""
    session = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, delay).groupBy(key, session.alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("last"))
    return grouped.select(key, F.col("w.start").alias("start"), "last", "n_events")


class _OpenIntervals(StatefulProcessor):
    """Open intervals of one sensor: (start, last) pairs in order of time, apart by at least the gap, and how many were closed."""

    def __init__(self, key: str, kind: str, gap: int, ms: int):
        self.key, self.kind, self.gap, self.ms = key, kind, gap, ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "starts array<bigint>, lasts array<bigint>, closed bigint")

    def _read(self):
        if not self.held.exists():
            return [], 0
        starts, lasts, closed = self.held.get()
        return [list(x) for x in zip(starts, lasts)], closed

    def _write(self, spans, closed):
        self.held.update(([a for a, _ in spans], [b for _, b in spans], closed))
        for _, last in spans:
            self.handle.registerTimer((last + self.gap) * self.ms)

    def handleInputRows(self, key, rows, timerValues):
        spans, closed = self._read()
        for pdf in rows:
            spans += [[int(f), int(f)] for f in pdf["frame"]]
        merged = []
        for start, last in sorted(spans):
            if merged and start - merged[-1][1] < self.gap:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([start, last])
        self._write(merged, closed)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        spans, closed = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        done = [s for s in spans if (s[1] + self.gap) * self.ms <= now]
        if done:
            self.held.update(([a for a, _ in spans[len(done) :]], [b for _, b in spans[len(done) :]], closed + len(done)))
            yield pd.DataFrame({self.key: [key[0]] * len(done), "run_id": range(closed + 1, closed + len(done) + 1), "start": [a for a, _ in done], "last": [b for _, b in done]})

    def close(self) -> None:
        pass


def sensor_intervals(motion: DataFrame, key: str, frame="frame", gap=20, late_frames=100, frame_ms=1000) -> DataFrame:
    """``(key, run_id, start, last)`` as data arrives: what ``intervals.active_intervals`` gives in batch.

    Frames are the clock: a frame stands for ``frame_ms`` of event time, and a sensor's interval closes when the stream as a
    whole has moved ``gap`` frames past its last one and ``late_frames`` more. Rows may come out of order by that much. Open
    intervals are kept in the state store between batches and restarts; a timer closes those of a sensor that fell silent.
    """
    spark = motion.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    on = motion.where(magnitude() > 0).select(F.col(key), F.col(frame).cast("bigint").alias("frame"), F.timestamp_millis(F.col(frame) * frame_ms).alias("_ts"))
    kind = motion.schema[key].dataType.simpleString()
    grouped = on.withWatermark("_ts", f"{late_frames * frame_ms} milliseconds").groupBy(key)
    return grouped.transformWithStateInPandas(_OpenIntervals(key, kind, gap, frame_ms), f"`{key}` {kind}, run_id bigint, start bigint, last bigint", "Append", "EventTime")


def first_arrivals(events: DataFrame, keys, ts="ts", delay="1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_stats(events: DataFrame, key: str, value: str, size: str, slide=None, ts="ts", delay="1 hour") -> DataFrame:
    """Mean, extremes and count per key and tumbling or sliding window; late rows beyond the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = events.withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def replay(df: DataFrame, epochs: int) -> DataFrame:
    """The rows once per epoch, as a source that is read again from the start."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
