"""Interval joins: rows of two sides whose spans of time meet.

Spark has no range join, so both sides are dealt to bins of a fixed width and joined by bin (and key);
the exact condition is checked on what meets, and a pair counts in one bin only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """df once for each bin of the given width that [start, end] touches, as _bin."""
    at = lambda c: F.floor(F.col(c) / width)
    return df.withColumn("_bin", F.explode(F.sequence(at(start), at(end))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float, how: str = "inner") -> DataFrame:
    """Pairs of one key whose [l_start, l_end] and [r_start, r_end] share a point, once each."""
    a, b = binned(left, "l_start", "l_end", width), binned(right, "r_start", "r_end", width)
    meet = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    once = F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / width)
    return a.join(b, [key, "_bin"], how).where(meet & once).drop("_bin")


def aligned(actions: DataFrame, segments: DataFrame, key: str, window: float, min_confidence: float = 0.0) -> DataFrame:
    """One row for each action with the segments that touch [ts - window, ts + window]: their text joined
    in their order, mean confidence, least start and greatest end. An action without any has empty
    text, its own time, and confidence 0. actions: (key, action_id, ts); segments: (key, pos,
    start, end, text, confidence)."""
    left = actions.select(key, "action_id", "ts", (F.col("ts") - window).alias("l_start"), (F.col("ts") + window).alias("l_end"))
    right = segments.select(key, "pos", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "text", "confidence")
    met = overlap_join(left, right, key, max(2 * window, 1e-9)).groupBy(key, "action_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.avg("confidence").alias("confidence"), F.min("r_start").alias("start"), F.max("r_end").alias("end"), F.count("*").alias("n_segments"),
    )
    out = actions.select(key, "action_id", "ts").join(met, [key, "action_id"], "left").select(
        key, "action_id", "ts", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("start", "ts").alias("start"), F.coalesce("end", "ts").alias("end"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"),
    )
    return out.where(F.col("confidence") >= min_confidence)


def assigned_speakers(words: DataFrame, speakers: DataFrame, key: str, width: float, unknown: str = "UNKNOWN") -> DataFrame:
    """Each word's speaker: that of the segment it overlaps most (of ties the first); of a word that
    overlaps none for any time, the last segment that contains its middle; else unknown. words:
    (key, word_id, start, end); speakers: (key, pos, start, end, speaker)."""
    left = words.select(key, "word_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = speakers.select(key, "pos", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "speaker")
    met = overlap_join(left, right, key, width)
    shared = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    middle = (F.col("l_start") + F.col("l_end")) / 2
    scored = met.withColumn("_shared", shared).withColumn("_inside", (F.col("r_start") <= middle) & (middle <= F.col("r_end")))
    best = scored.groupBy(key, "word_id").agg(
        F.max_by(F.when(F.col("_shared") > 0, F.col("speaker")), F.when(F.col("_shared") > 0, F.struct("_shared", -F.col("pos")))).alias("_by_time"),
        F.max_by(F.when(F.col("_inside"), F.col("speaker")), F.when(F.col("_inside"), F.col("pos"))).alias("_by_middle"),
    )
    return words.join(best, [key, "word_id"], "left").withColumn("speaker", F.coalesce("_by_time", "_by_middle", F.lit(unknown))).drop("_by_time", "_by_middle")


def containing(points: DataFrame, spans: DataFrame, key: str, width: float, value: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Each point's value: that of the first span (by pos) that contains it, else unknown. points: (key,
    point_id, at); spans: (key, pos, start, end, value)."""
    left = points.withColumn("l_start", F.col("at")).withColumn("l_end", F.col("at"))
    right = spans.select(key, "pos", F.col("start").alias("r_start"), F.col("end").alias("r_end"), value)
    met = overlap_join(left, right, key, width).groupBy(key, "point_id").agg(F.min_by(value, "pos").alias(value))
    return points.join(met, [key, "point_id"], "left").withColumn(value, F.coalesce(value, F.lit(unknown)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the latest right row of its key at or before it, by one sort of both."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_left", F.lit(0)), allowMissingColumns=True
    )
    by = Window.partitionBy(key).orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(by)).where("_left = 1").drop("_v", "_left")
