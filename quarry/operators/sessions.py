"""Runs and sessions of ordered events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from quarry.session import checkpointed


def task_spans(
    events: DataFrame, session: str, ts: str, order: str, kind: str, label: Column,
    openers: tuple[str, ...], gap_seconds: float, min_actions: int = 1,
) -> DataFrame:
    """Spans of a session's actions: a new span opens at an action of an opening kind, or when the
    time since the previous action exceeds the gap (strictly). Spans with fewer than min_actions are
    dropped before numbering. The title is the label of the span's first opener, else the kind of
    its first action. One shuffle by session; the later aggregate reuses its partitioning.
    """
    by = Window.partitionBy(session).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    opens = F.col(kind).isin(*openers)
    marked = events.withColumn("_gap", seconds - F.lag(seconds).over(by)).withColumn(
        "_new", (F.col("_gap").isNull() | opens | (F.col("_gap") > int(gap_seconds * 1e6))).cast("int")
    )
    placed = marked.withColumn("_span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy(session, "_span").agg(
        F.count("*").alias("n_actions"),
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.min_by(F.when(opens, label), F.when(opens, F.struct(ts, order))).alias("_opened"),
        F.min_by(kind, F.struct(ts, order)).alias("_first"),
    )
    number = F.row_number().over(Window.partitionBy(session).orderBy("_span")) - 1
    return spans.where(F.col("n_actions") >= min_actions).select(
        session, number.alias("span_index"), F.coalesce("_opened", "_first").alias("title"), "n_actions", "start_ts", "end_ts"
    )


def runs(rows: DataFrame, key: str, order: list[str], value: str, unknown: str | None = None) -> DataFrame:
    """Adds run, the number (from 0) of each maximal run of equal values in a key's order. Values equal
    to `unknown` take the last known one first (a leading unknown stays)."""
    by = Window.partitionBy(key).orderBy(*order)
    if unknown is not None:
        known = F.when(F.col(value) != unknown, F.col(value))
        rows = rows.withColumn(value, F.coalesce(F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(unknown)))
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)
    return rows.withColumn("_c", changed.cast("int")).withColumn("run", (F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_c")


def turns(rows: DataFrame, key: str, order: list[str], speaker: str, text: str, unknown: str | None = None) -> DataFrame:
    """(key, run, speaker, text, n): consecutive rows of one speaker joined, in order, by a space."""
    grouped = runs(rows, key, order, speaker, unknown).groupBy(key, "run").agg(
        F.first(speaker).alias(speaker), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(*order, text))).alias("_rows"),
    )
    joined = F.array_join(F.transform("_rows", lambda x: x[text]), " ")
    return grouped.select(key, "run", speaker, joined.alias(text), "n")


def collapse_inputs(rows: DataFrame, key: str, order: list[str], kind: str, target: str, value: str, kinds: tuple[str, ...]) -> DataFrame:
    """Consecutive rows of input kinds on one target become one row that has the last value; other rows
    stay. Adds n, how many rows were put together."""
    by = Window.partitionBy(key).orderBy(*order)
    is_input = F.col(kind).isin(*kinds)
    same = is_input & F.lag(is_input).over(by) & F.col(target).eqNullSafe(F.lag(target).over(by))
    marked = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("step", (F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    at = F.struct(*order)
    return marked.groupBy(key, "step").agg(
        F.max_by(kind, at).alias(kind), F.max_by(target, at).alias(target), F.max_by(value, at).alias(value), F.count("*").alias("n")
    )


def without_adjacent_copies(rows: DataFrame, key: str, order: list[str], mark: str) -> DataFrame:
    """Rows whose mark differs from that of the row before them; the first row of a key stays."""
    by = Window.partitionBy(key).orderBy(*order)
    before = F.lag(mark).over(by)
    first = F.row_number().over(by) == 1
    return rows.withColumn("_keep", first | ~F.col(mark).eqNullSafe(before)).where("_keep").drop("_keep")


def every_kth(rows: DataFrame, key: str, order: list[str], k: int, most: int | None = None) -> DataFrame:
    """Rows 0, k, 2k, ... of a key's order, at most so many."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    kept = rows.withColumn("_at", at).where(F.col("_at") % k == 0)
    kept = kept.where(F.col("_at") < k * most) if most is not None else kept
    return kept.drop("_at")


def action_ngrams(spans: DataFrame, span: list[str], order: str, kind: str, n: int = 3, least: int = 2, min_confidence: float = 0.1) -> DataFrame:
    """(gram, frequency, confidence): runs of n kinds within spans, counted as often as they occur, of
    those that occur at least so often; confidence is frequency by number of spans, at most 1."""
    listed = spans.groupBy(*span).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind]).alias("_k"))
    total = F.broadcast(listed.agg(F.count("*").alias("_spans")))
    grams = listed.where(F.size("_k") >= n).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("_k") - n + 1), lambda i: F.array_join(F.slice("_k", i, n), " → "))).alias("gram")
    )
    counted = grams.groupBy("gram").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    scored = counted.crossJoin(total).withColumn("confidence", F.least(F.lit(1.0), F.col("frequency") / F.col("_spans")))
    return scored.where(F.col("confidence") >= min_confidence).select("gram", "frequency", "confidence")


def windowed_counts(rows: DataFrame, key: str, ts: str, seconds: float, threshold: int) -> DataFrame:
    """Adds n_recent, the rows of the key within the last so many seconds (both ends in), and alert."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    by = Window.partitionBy(key).orderBy(micros).rangeBetween(-int(seconds * 1e6), 0)
    return rows.withColumn("n_recent", F.count("*").over(by)).withColumn("alert", F.col("n_recent") >= threshold)


def folded(rows: DataFrame, key: str, order: list[str], needs: list[str], start: object, step: Callable, out: str, kind: DataType) -> DataFrame:
    """rows with a column that a fold over each key's rows in order gives: step(state, values of the columns in
    needs) gives the next state and the row's value; a key begins with start. Rows stream through in
    their sorted order, so a task holds a state and a batch, however many rows a key has; a key's
    rows still go through one task, as the definition asks."""
    schema = StructType([*rows.schema.fields, StructField(out, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), start
        for batch in batches:
            made = []
            for own, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in needs), strict=True):
                if own != current:
                    current, state = own, start
                state, value = step(state, *values)
                made.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*batch.schema.names, out])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


#: Bins of a gap that are put in order together; what a key has beyond that is put in order by such runs.
RUN = 4096


def _micros(seconds: float) -> int:
    return int(round(seconds * 1e6))


def _ordered(marks: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """marks, (keys, at) without repeats, with number (from 0, in order within a key) and following (the next at).
    Marks are put in order in runs of `width`, and runs by their counts, so no task holds all of a
    key unless its runs are as many."""
    runs = marks.withColumn("_run", F.col(at) - F.pmod(F.col(at), F.lit(width)))
    within = Window.partitionBy(*keys, "_run").orderBy(at)
    over = Window.partitionBy(*keys).orderBy("_run")
    sums = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    sums = sums.select(*keys, "_run", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(over).alias("_next"))
    placed = runs.withColumns({"_in": F.row_number().over(within) - 1, "_after": F.lead(at).over(within)})
    return placed.join(sums, [*keys, "_run"]).select(*marks.columns, (F.col("_before") + F.col("_in")).alias("number"), F.coalesce("_after", "_next").alias("following"))


def _chained(times: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, t) of the times that a walk of each key takes: its first, then always the first that is `step` or
    more behind the last one taken. times, (keys, t), has no repeats.

    Where a walk would go from each time is found by bins of a step: that is in the next bin, or the first
    time of the next bin that has one. Then pointers are doubled: after k rounds the walk's first 2^k
    places are marked, so rounds grow with the logarithm of the longest walk. Joins are by key and time, so
    a key's times are dealt to all tasks."""
    binned = times.withColumn("bin", F.col("t") - F.pmod(F.col("t"), F.lit(step)))
    firsts = _ordered(binned.groupBy(*keys, "bin").agg(F.min("t").alias("t")).select(*keys, "bin"), keys, "bin", step * RUN)
    least = binned.groupBy(*keys, "bin").agg(F.min("t").alias("first"))
    # the first time at or behind t + step in the bin of that time
    asked = binned.select(*keys, "t", (F.col("bin") + step).alias("bin"), (F.col("t") + step).alias("at"), F.lit(None).cast("long").alias("own"))
    held = binned.select(*keys, F.lit(None).cast("long").alias("t"), "bin", F.col("t").alias("at"), F.col("t").alias("own"))
    ahead = Window.partitionBy(*keys, "bin").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    near = asked.unionByName(held).withColumn("next", F.min("own").over(ahead)).where("t is not null").select(*keys, "t", (F.col("bin") - step).alias("bin"), "next")
    # else the first of the next bin beyond that one
    later = firsts.select(*keys, "bin", "following").join(least.select(*keys, F.col("bin").alias("following"), F.col("first").alias("then")), [*keys, "following"])
    beyond = later.select(*keys, "bin", "following", "then")
    after = beyond.join(beyond.select(*keys, F.col("bin").alias("following"), F.col("then").alias("_second")), [*keys, "following"], "left")
    far = after.select(*keys, "bin", F.when(F.col("following") > F.col("bin") + step, F.col("then")).otherwise(F.col("_second")).alias("far"))
    jumps = checkpointed(near.join(far, [*keys, "bin"], "left").select(*keys, "t", F.coalesce("next", "far").alias("next")).where("next is not null"))
    taken = checkpointed(times.groupBy(*keys).agg(F.min("t").alias("t")))
    while True:
        reached = taken.join(jumps, [*keys, "t"]).select(*keys, F.col("next").alias("t"))
        if reached.isEmpty():
            return taken
        taken = checkpointed(taken.unionByName(reached))
        jumps = checkpointed(jumps.join(jumps.select(*keys, F.col("t").alias("next"), F.col("next").alias("_then")), [*keys, "next"]).select(*keys, "t", F.col("_then").alias("next")))


def _keyed(rows: DataFrame, key: str, t: Column) -> DataFrame:
    """rows with _k and _null, the key without nulls and whether it is null, so that joins find null keys, and _t."""
    kind = rows.schema[key].dataType.simpleString()
    none = F.lit("") if kind == "string" else F.lit(0).cast(kind)
    return rows.withColumns({"_k": F.coalesce(F.col(key), none), "_null": F.col(key).isNull(), "_t": t})


def spaced(rows: DataFrame, key: str, order: str, ts: str, seconds: float, strict: bool = False) -> DataFrame:
    """Rows accepted when the last accepted one of their key is at least so many seconds back (more than that, if
    strict): a cooldown, a dedup window or a delivery limit. Of rows of one time the first by `order` counts. Rows
    without a time are all accepted and hold nobody back; null keys are a key. No task holds a key's
    rows: see _chained."""
    step = _micros(seconds) + (1 if strict else 0)
    timed = _keyed(rows, key, F.unix_micros(F.col(ts).cast("timestamp")))
    if step <= 0:
        return rows
    marks = _chained(timed.where("_t is not null").select("_k", "_null", F.col("_t").alias("t")).distinct(), ["_k", "_null"], step)
    at = timed.join(marks.withColumnRenamed("t", "_t"), ["_k", "_null", "_t"])
    whole = F.struct(*rows.columns)
    first = at.groupBy("_k", "_null", "_t").agg(F.min_by(whole, F.struct(F.col(order).isNotNull(), order)).alias("r")).select("r.*")
    return first.unionByName(rows.where(F.col(ts).isNull()))


def transitions(rows: DataFrame, key: str, order: list[str], status: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, before, after, legal) for each change of status in order; the first status has no before."""
    by = Window.partitionBy(key).orderBy(*order)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, x in allowed.items() for b in x]
    moved = rows.withColumn("before", F.lag(status).over(by)).withColumn("after", F.col(status))
    legal = F.col("before").isNull() | F.array_contains(F.array(*pairs), F.struct(F.col("before").alias("a"), F.col("after").alias("b")))
    return moved.select(key, *order, "before", "after", legal.alias("legal"))


def latest(rows: DataFrame, key: list[str], order: list[str], nth: int = 1) -> DataFrame:
    """The nth row from the last of each key: upserts (1), rollbacks (2)."""
    by = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") == nth).drop("_r")


def cron_due(start: str, end: str, minutes: tuple[int, ...], hours: tuple[int, ...], spark) -> DataFrame:
    """The minutes between two times at which a schedule of minutes and hours is due."""
    span = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr("interval 1 minute"))).alias("due"))
    return span.where(F.minute("due").isin(*minutes) & F.hour("due").isin(*hours))


def backoff(attempts: DataFrame, attempt: str, base: float, factor: float, most: float) -> DataFrame:
    """Adds delay, the wait after the nth attempt: base times factor to the power n - 1, at most so long."""
    return attempts.withColumn("delay", F.least(F.lit(float(most)), base * F.pow(F.lit(float(factor)), F.col(attempt) - 1)))


def fixed_windows(rows: DataFrame, key: str, start: str, end: str, text: str, seconds: float) -> DataFrame:
    """(key, segment, start, end, text, n): words put together in windows that begin with the first word
    not in the window before and are so many seconds long. Where windows begin hangs on where those
    before began: see _chained. Words without a start are in no window; null keys are a key. A window's
    words meet in one row."""
    step, keys = max(1, _micros(seconds)), ["_k", "_null"]
    timed = _keyed(rows.select(key, start, end, text), key, F.round(F.col(start) * 1e6).cast("long")).where("_t is not null")
    timed = timed.withColumn("_bin", F.col("_t") - F.pmod(F.col("_t"), F.lit(step)))
    marks = _chained(timed.select(*keys, F.col("_t").alias("t")).distinct(), keys, step)
    numbered = checkpointed(_ordered(marks, keys, "t", step * RUN).withColumn("_bin", F.col("t") - F.pmod(F.col("t"), F.lit(step))))
    # a window that a word is in began in the word's bin or in the one before, and no bin has two
    own = numbered.select(*keys, "_bin", F.col("t").alias("_own"), F.col("number").alias("_own_number"))
    before = numbered.select(*keys, (F.col("_bin") + step).alias("_bin"), F.col("number").alias("_number"))
    placed = timed.join(own, [*keys, "_bin"], "left").join(before, [*keys, "_bin"], "left")
    segment = F.when(F.col("_own") <= F.col("_t"), F.col("_own_number")).otherwise(F.col("_number")).cast("int")
    return placed.withColumn("segment", segment).groupBy(key, "segment").agg(
        F.min(start).alias("start"), F.max(end).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, end, text))), lambda v: v[text]), " ").alias("text"), F.count("*").alias("n"),
    )
