"""Event streams: windows, sessions, and stateful operators that a batch and a stream share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds for which a repeated search of a session isn't stored again.
QUIET_S = 60
#: A batch is due after so many events, or so many seconds.
BATCH_EVENTS, BATCH_S = 8, 300


def windows(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """events: ts (timestamp), event_type, value. Counts and sums by window and type; late sets the watermark of a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Lifetimes of users' sessions, which end after a gap."""
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n")


def _stored(stamps: list[int], last: int | None, quiet: int) -> tuple[list[bool], int | None]:
    """Whether each of ascending times is stored; the quiet time counts from the last one that was."""
    kept = []
    for s in stamps:
        kept.append(last is None or s - last >= quiet)
        if kept[-1]:
            last = s
    return kept, last


def dedup_anchored(events: DataFrame, quiet: int = QUIET_S) -> DataFrame:
    """events: event_id, key, ts_s. Those that are stored. A key's events are sorted and read in one pass."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_s", "event_id"])
        return pdf.loc[_stored(pdf["ts_s"].tolist(), None, quiet)[0], ["event_id", "key", "ts_s"]]

    return events.select("event_id", "key", "ts_s").groupBy("key").applyInPandas(one, "event_id long, key string, ts_s long")


def dedup_stream(events: DataFrame, quiet: int = QUIET_S, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: the time of a key's last stored event is its state, which ends when the watermark has passed its quiet time."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["ts_s", "event_id"])
        kept, last = _stored(pdf["ts_s"].tolist(), state.get[0] if state.exists else None, quiet)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + quiet) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf.loc[kept, ["event_id", "key", "ts_s"]]

    timed = events.select("event_id", "key", "ts_s", F.timestamp_seconds("ts_s").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(one, "event_id long, key string, ts_s long", "last long", "append", "EventTimeTimeout")


def due_batches(events: DataFrame, most: int = BATCH_EVENTS, seconds: int = BATCH_S) -> DataFrame:
    """events: event_id, key, ts_s. The batch each falls in; one ends when it holds `most` events or its first is `seconds` old."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_s", "event_id"])
        batch, size, first, out = 0, 0, None, []
        for s in pdf["ts_s"]:
            if first is not None and (size >= most or s - first >= seconds):
                batch, size, first = batch + 1, 0, None
            first = s if first is None else first
            size += 1
            out.append(batch)
        return pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "batch": out})

    return events.select("event_id", "key", "ts_s").groupBy("key").applyInPandas(one, "event_id long, key string, batch long")


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files; times become timestamps, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs what there is of a stream to its end into a table in memory, for checks."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
