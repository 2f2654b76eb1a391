"""Queries on streams: the events are appended to a folder batch after batch, and a stream reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans._registry import Registry
from quarry.session import checkpointed, shared_dir, table
from quarry.streaming import events as streams
from quarry.streaming import late, limits

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles

#: Two requests a day, two at once; a user that is silent for three days begins anew.
LIMIT = limits.Limit(rate=2 / 86400, burst=2.0, slowest=1 / 345600, wins=3, expire=3 * 86400.0)
BATCHES = 4


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"


def _in_equal_times(rows: DataFrame, at: str, batches: int = BATCHES) -> DataFrame:
    """The rows with batch, the part of the table's time, from its first row to its last, that they arrive in."""
    micros = F.unix_micros(at)
    ends = rows.agg(F.min(micros).alias("low"), F.max(micros).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    return rows.withColumn("batch", F.expr(f"(unix_micros({at}) - {low}L) * {batches} div {high - low + 1}L"))


def _buckets_sql(limit: limits.Limit) -> str:
    rate, burst, slowest, expire = (f"{x!r}::double" for x in (limit.rate, limit.burst, limit.slowest, limit.expire))
    return f"""
with recursive r as materialized (select user_id, event_id, epoch_us(ts) as t, event_type = 'error' as pushed, row_number() over (partition by user_id order by ts, event_id) as n from events),
c as (
  select distinct user_id, 0::bigint as n, null::bigint as event_id, null::bigint as t, {burst} as tokens, {rate} as rate, 0 as won, null::boolean as allowed, null::double as wait from r
  union all
  select user_id, n, event_id, t, case when allowed then filled - 1 else filled end,
    case when not allowed then rate when pushed then greatest({slowest}, rate / 2) when (won + 1) % {limit.wins} = 0 then least({limit.rate!r}::double, rate * 1.1::double) else rate end,
    case when not allowed then won when pushed then 0 else won + 1 end, allowed, case when allowed then 0 else (1 - filled) / rate end
  from (select *, filled >= 1 as allowed from (
    select r.user_id, r.n, r.event_id, r.t, r.pushed, case when anew then {burst} else least({burst}, c.tokens + (r.t - c.t) / 1e6::double * c.rate) end as filled,
      case when anew then {rate} else c.rate end as rate, case when anew then 0 else c.won end as won
    from (select *, from_c.t as was from c as from_c) as c join r on r.user_id = c.user_id and r.n = c.n + 1, lateral (select c.was is null or r.t - c.was >= {expire} * 1000000 as anew)
  )))
select user_id, event_id, allowed, round(wait, 3) as wait, round(rate * 86400, 6) as per_day from c where n > 0"""


@_r.query("r7_token_buckets", _buckets_sql(LIMIT))
def r7_token_buckets(spark, sf_dir):
    """Events as requests of their users, errors as requests pushed back, replayed in batches: which are
    allowed, and how long the others wait."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") == "error").alias("pushed"))
    rows = _in_equal_times(rows, "ts")

    def run() -> DataFrame:
        stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, pushed boolean").parquet(f"{folder}/in")
        with limits.rocks(spark):
            return streams.stored(limits.rate_limited(stream, "user_id", "ts", "event_id", "pushed", "1 hour", LIMIT), f"{folder}/out", f"{folder}/state")

    streams.in_batches(rows, "batch", f"{folder}/in", run)
    out = spark.read.schema("user_id long, event_id long, allowed boolean, wait double, rate double").parquet(f"{folder}/out")
    return out.select("user_id", "event_id", "allowed", F.round("wait", 3).alias("wait"), F.round(F.col("rate") * 86400, 6).alias("per_day"))


#: Every tenth event comes five days late; windows of a day wait for one day.
HELD_BACK, DELAY = 5, 86_400


@_r.query(
    "r2_late_rows",
    f"""
with a as (select event_id, ts, epoch_us(ts) + case when event_id % 10 = 0 then {HELD_BACK} * 86400000000 else 0 end as arrives from events),
e as (select min(arrives) as low, max(arrives) as high from a),
b as (select a.*, (arrives - low) * {BATCHES} // (high - low + 1) as batch from a, e),
m as (select batch, max(epoch_ms(ts)) as mark from b group by batch),
w as (select b.batch, max(m.mark) - {DELAY} * 1000 as mark from (select distinct batch from b) as b left join m on m.batch < b.batch group by b.batch),
l as (select time_bucket(interval 1 day, b.ts) as start, coalesce(epoch_ms(time_bucket(interval 1 day, b.ts) + interval 1 day) <= w.mark, false) as late from b join w using (batch))
select start, count(*) filter (where not late) as n_in_time, count(*) filter (where late) as n_late from l group by start""",
)
def r2_late_rows(spark, sf_dir):
    """Events of which every tenth arrives days late, in batches: what Spark's watermark lets into windows
    of a day, and what a second sink of the same stream keeps of the rows that it drops."""
    folder = _folder(spark)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    arrives = F.col("ts") + F.when(F.col("event_id") % 10 == 0, F.expr(f"interval {HELD_BACK} days")).otherwise(F.expr("interval 0 days"))
    rows = checkpointed(_in_equal_times(rows.withColumn("arrives", arrives), "arrives").drop("arrives"))
    # a row far ahead, in a batch of its own, closes all windows
    ahead = rows.agg(F.lit(None).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 90 days")).alias("ts"), F.lit(BATCHES).cast("long").alias("batch")).where("ts is not null")
    day = F.window("ts", "1 day")

    def run() -> None:
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{folder}/in")
        streams.stored(streams.tumbling(stream, "ts", "1 day", f"{DELAY} seconds"), f"{folder}/windows", f"{folder}/state")
        sink = late.split(f"{folder}/split", "ts", F.window("ts", "1 day")["end"], DELAY)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/split-state").trigger(availableNow=True).start().awaitTermination()

    streams.in_batches(rows.unionByName(ahead), "batch", f"{folder}/in", run)
    windows = spark.read.schema("start timestamp, n long").parquet(f"{folder}/windows").groupBy("start").agg(F.sum("n").alias("n_in_time"))
    dropped = spark.read.schema("event_id long, ts timestamp, late boolean").parquet(f"{folder}/split/rows").where("late").groupBy(day["start"].alias("start")).agg(F.count("*").alias("n_late"))
    out = windows.join(dropped, "start", "full").select(F.col("start").cast("timestamp_ntz").alias("start"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_in_time", "n_late")])
    return out
