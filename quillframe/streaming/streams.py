"""Structured Streaming over the append-only logs: tail, last feedback, predict-feedback join, rolling rates, seed dedup."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import latency

EVENTS = "event_id long, ts timestamp, sample long, event string, status string, latency_ms double"


def tail(spark: SparkSession, path: str, schema: str | StructType = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """New lines of a JSON log folder; lines that do not parse have only nulls and are left out."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return df.where(F.coalesce(*[F.col(c).isNotNull() for c in df.columns[:1]]))


def rolling(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events, error rate and mean latency by window and event; tumbling without a slide. Works on batches and streams."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = df.groupBy(window.alias("w"), "event").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "error").cast("double")).alias("error_rate"), F.avg("latency_ms").alias("mean_latency"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n", "error_rate", "mean_latency")


def window_sketches(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """start, end, event, sketch: latencies by tumbling window and event, as mergeable sketches. Works on batches and streams."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    out = latency.sketches(df, [F.window("ts", size).alias("w"), "event"], "latency_ms")
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "sketch")


def predict_feedback(predictions: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Each prediction with the feedback on its sample that came within a time; null without one.

    On streams, feedback that arrives after the watermark is dropped and its prediction comes out without it.
    """
    p = predictions.select("sample", "ts", F.col("status").alias("predicted"))
    f = feedback.select(F.col("sample").alias("f_sample"), F.col("ts").alias("f_ts"), F.col("status").alias("feedback"))
    if predictions.isStreaming:
        p, f = p.withWatermark("ts", late), f.withWatermark("f_ts", late)
    on = F.expr(f"sample = f_sample and f_ts >= ts and f_ts <= ts + interval {within}")
    return p.join(f, on, "left_outer").select("sample", "ts", "predicted", "f_ts", "feedback")


def last_feedback(feedback: DataFrame) -> DataFrame:
    """The last feedback of each sample, by time and event id. An aggregate: a sample with many rows sends one from each task."""
    last = F.max_by(F.struct(*[F.col(c) for c in feedback.columns]), F.struct("ts", "event_id"))
    return feedback.groupBy(F.col("sample").alias("__s")).agg(last.alias("__l")).select("__l.*")


class LastFeedback(StatefulProcessor):
    """Keyed state of one sample: its last feedback, forgotten when event time has passed it by ``keep_ms``."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long, event_id long, due_ms long")

    def handleInputRows(self, key, rows, timerValues):
        best = None
        for pdf in rows:
            pdf = pdf[pdf["ts"].notna()]
            if len(pdf):
                row = pdf.sort_values(["ts", "event_id"], na_position="first").iloc[[-1]]
                if best is None or self._place(row) > self._place(best):
                    best = row
        if best is None:
            return
        place = self._place(best)
        had = self.last.get() if self.last.exists() else None
        if had is not None and (had[0], had[1]) >= place:
            return
        if had is not None:
            self.handle.deleteTimer(had[2])
        due = max(place[0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        self.handle.registerTimer(due)
        self.last.update((*place, due))
        yield best

    @staticmethod
    def _place(row) -> tuple[int, int]:
        event = row["event_id"].iloc[0]
        return row["ts"].iloc[0].value // 1000, -(1 << 62) if pd.isna(event) else int(event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_feedback_changes(feedback: DataFrame, keep: str = "7 days", late: str = "30 minutes") -> DataFrame:
    """Stream form of last_feedback: a row whenever a sample's last feedback changes.

    Each sample holds one row of state (time and id of its last feedback) and a timer in event time; when the watermark
    passes that feedback by ``keep`` the state goes. Rows later than the watermark are dropped, so that what comes after the
    state has gone is newer than it. A row that does not come after the last one changes nothing; rows without a sample or a
    time are left out. The session's state store has to be RocksDB's.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = feedback.where("sample is not null and ts is not null").withWatermark("ts", late)
    return rows.groupBy("sample").transformWithStateInPandas(LastFeedback(keep_ms), rows.schema, "Append", "EventTime")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_last_feedback(feedback: DataFrame, path: str, checkpoint: str, keep: str = "7 days", late: str = "30 minutes"):
    """Append the changes to a table; a restart goes on from the checkpoint. ``kept_feedback`` reads the last of each sample."""
    spark = feedback.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STATE_STORE)
    try:
        changes = last_feedback_changes(feedback, keep, late)
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)


def kept_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The last feedback of each sample over all changes."""
    return last_feedback(spark.read.parquet(path))


def compact_feedback(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Write the last feedback of each sample to a new folder."""
    kept_feedback(spark, path).write.parquet(target)
    return kept_feedback(spark, target)


def fresh_seeds(served: DataFrame, late: str = "1 day") -> DataFrame:
    """Seeds the first time they are served (columns seed, ts); on streams within the watermark."""
    if served.isStreaming:
        return served.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seed"])
    return served.groupBy("seed").agg(F.min("ts").alias("ts"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to a JSON log."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
