"""Streams of events: windows, sessions, alerts, deduplication and sealed batches.

Everything works on event time with a watermark: rows later than it are dropped, state behind it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators import provenance


def replayed(spark: SparkSession, path: str, schema: str, per_trigger: int = 1, ts: str = "ts") -> DataFrame:
    """Parquet files of a folder as a stream, so many a batch; ts as a timestamp."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    """(start, keys, n) of windows of a size."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def sliding_alerts(events: DataFrame, ts: str, size: str, slide: str, late: str, threshold: int, *keys: str) -> DataFrame:
    """(start, end, keys, n) of sliding windows with at least so many events."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= threshold).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    """(keys, start, end, n) of sessions that end after a pause. A pause of exactly the gap ends one here,
    while the batch operator needs more than the gap."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def cooled_down(events: DataFrame, ts: str, late: str, key: str, threshold: int, window_seconds: float, cooldown_seconds: float) -> DataFrame:
    """(key, fired_at, n): an alert whenever a key has so many events within a window, not sooner than the
    cooldown after its last one. The state of a key is the times in its window and its last alert."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, last = (list(state.get[0]), state.get[1]) if state.exists else ([], -1e18)
        if state.hasTimedOut:
            state.remove()
            return
        fired = []
        times = sorted(t for b in batches for t in b["_t"])
        for t in times:
            recent = [x for x in recent if x >= t - window_seconds] + [t]
            if len(recent) >= threshold and t - last >= cooldown_seconds:
                last = t
                fired.append((group[0], pd.Timestamp(t, unit="s"), len(recent)))
        state.update((recent, last))
        if times:
            until = max(times[-1], state.getCurrentWatermarkMs() / 1000) + max(window_seconds, cooldown_seconds)
            state.setTimeoutTimestamp(int(until * 1000) + 1)
        if fired:
            yield pd.DataFrame(fired, columns=[key, "fired_at", "n"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late).withColumn("_t", F.unix_micros(ts) / 1e6)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, fired_at timestamp, n int", "recent array<double>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def counters(events: DataFrame, key: str) -> DataFrame:
    """Running counts of a component's events."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def sealed(path: str, key: str, order: str, content_hash: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: appends each batch's Merkle roots once; a batch that is run again replaces
    its own folder."""

    def run(batch: DataFrame, epoch: int) -> None:
        provenance.merkle_roots(batch, key, [order], content_hash).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def with_dead_letters(write: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the batches which another sink fails on, with the error."""

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            write(batch, epoch)
        except Exception as e:  # noqa: BLE001  whatever a sink raises
            batch.withColumn("error", F.lit(f"{type(e).__name__}: {e}"[:500])).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def drained(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over all that is there now into a table in memory."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query


def stored(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet files: appended once (append), or the last
    result (complete). Run again with the same folders, it goes on behind what it has read."""
    if mode == "complete":
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(path))
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def in_batches(rows: DataFrame, batch: str, folder: str, run: Callable[[], object]) -> None:
    """Appends the rows of each value of a column of batch numbers to a folder, in order, and calls `run`
    after each: a stream on the folder sees batch after batch, whatever files they are dealt to."""
    numbers = sorted(r[0] for r in rows.select(batch).distinct().collect())
    for number in numbers:
        rows.where(F.col(batch) == number).drop(batch).write.mode("append").parquet(folder)
        run()
