"""Queries over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import intervals, sessions
from quarry.plans._registry import Registry
from quarry.session import table

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


@_r.query(
    "w1_task_spans",
    """
with m as (select *, ts - lag(ts) over w as gap from events window w as (partition by user_id order by ts, event_id)),
n as (select *, case when gap is null or event_type = 'view' or gap > interval 6 hour then 1 else 0 end as is_new from m),
p as (select *, sum(is_new) over (partition by user_id order by ts, event_id rows unbounded preceding) as span from n),
g as (select user_id, span, count(*) as n_actions, min(ts) as start_ts, max(ts) as end_ts,
  coalesce(arg_min(case when event_type = 'view' then props end, case when event_type = 'view' then event_id end),
           arg_min(event_type, event_id)) as title from p group by all)
select user_id, row_number() over (partition by user_id order by span) - 1 as span_index, title, n_actions, start_ts, end_ts
from g where n_actions >= 2
""",
)
def w1_task_spans(spark, sf_dir):
    """Task spans of each user's events: view opens a span, and so does a pause of over six hours."""
    return sessions.task_spans(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", F.col("props"), ("view",), 6 * 3600, 2)


_SPANS = """
with m as (select *, ts - lag(ts) over w as gap from events window w as (partition by user_id order by ts, event_id)),
n as (select *, case when gap is null or event_type = 'view' or gap > interval 6 hour then 1 else 0 end as is_new from m),
p as (select *, sum(is_new) over (partition by user_id order by ts, event_id rows unbounded preceding) as span from n)"""


def _spanned(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("_gap", seconds - F.lag(seconds).over(by))
    new = (F.col("_gap").isNull() | (F.col("event_type") == "view") | (F.col("_gap") > 6 * 3600 * 1_000_000)).cast("int")
    return rows.withColumn("_new", new).withColumn("span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))


@_r.query(
    "a10_action_ngrams",
    _SPANS + """, l as (select user_id, span, list(event_type order by event_id) as k from p group by all),
g as (select unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i+2], ' → '))) as gram from l where len(k) >= 3),
c as (select gram, count(*) as frequency from g group by gram having count(*) >= 2)
select gram, frequency, round(least(1.0, frequency / (select count(*) from l)::double), 9) as confidence from c where frequency / (select count(*) from l)::double >= 0.001""",
)
def a10_action_ngrams(spark, sf_dir):
    """Runs of three event types within spans."""
    found = sessions.action_ngrams(_spanned(spark, sf_dir), ["user_id", "span"], "event_id", "event_type", 3, 2, 0.001)
    return found.withColumn("confidence", F.round("confidence", 9))


@_r.query(
    "w2_turns",
    """
with c as (select *, case when role is distinct from lag(role) over w then 1 else 0 end as n from conversations window w as (partition by conv_id order by turn)),
r as (select *, sum(n) over (partition by conv_id order by turn rows unbounded preceding) - 1 as run from c)
select conv_id, run::int as run, any_value(role) as role, string_agg(text, ' ' order by turn) as text, count(*) as n from r group by conv_id, run""",
)
def w2_turns(spark, sf_dir):
    """Consecutive messages of a role."""
    return sessions.turns(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "role", "text")


@_r.query(
    "w2_gap_filled_turns",
    """
with c as (select user_id, event_id, coalesce(last_value(case when event_type <> 'error' then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding), 'error') as s from events),
d as (select *, case when s is distinct from lag(s) over (partition by user_id order by event_id) then 1 else 0 end as n from c),
r as (select *, sum(n) over (partition by user_id order by event_id rows unbounded preceding) - 1 as run from d)
select user_id, run::int as run, any_value(s) as event_type, count(*) as n from r group by user_id, run""",
)
def w2_gap_filled_turns(spark, sf_dir):
    """Runs of event types, errors standing for an unknown type that inherits the last one."""
    marked = sessions.runs(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", unknown="error")
    return marked.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@_r.query(
    "w4_collapsed_inputs",
    """
with e as (select *, event_type in ('click', 'view') as i, props as target from events),
m as (select *, case when i and lag(i) over w and target is not distinct from lag(target) over w then 0 else 1 end as n from e window w as (partition by user_id order by event_id)),
s as (select *, sum(n) over (partition by user_id order by event_id rows unbounded preceding) - 1 as step from m)
select user_id, step::int as step, arg_max(event_type, event_id) as event_type, arg_max(target, event_id) as props, arg_max(value, event_id) as value, count(*) as n from s group by user_id, step""",
)
def w4_collapsed_inputs(spark, sf_dir):
    """Consecutive clicks and views on one target as one step with the last value."""
    return sessions.collapse_inputs(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "props", "value", ("click", "view"))


@_r.query(
    "w5_alert_counts",
    """select event_id, user_id, count(*) over (partition by event_type order by ts range between interval 1 hour preceding and current row) as n_recent,
  count(*) over (partition by event_type order by ts range between interval 1 hour preceding and current row) >= 5 as alert from events""",
)
def w5_alert_counts(spark, sf_dir):
    """Events of a type within the last hour, and whether there are five."""
    out = sessions.windowed_counts(table(spark, sf_dir, "events"), "event_type", "ts", 3600, 5)
    return out.select("event_id", "user_id", "n_recent", "alert")


def _spaced_sql(key: str, where: str, seconds: int, out: str) -> str:
    return f"""
with recursive r as materialized (select *, {key} as k, row_number() over (partition by {key} order by ts, event_id) as n from events where {where}),
c as (select k, n, event_id, user_id, ts, ts as last, true as taken from r where n = 1
  union all select r.k, r.n, r.event_id, r.user_id, r.ts, case when r.ts >= c.last + interval {seconds} second then r.ts else c.last end, r.ts >= c.last + interval {seconds} second from c join r on r.k = c.k and r.n = c.n + 1)
select {out} from c where taken"""


@_r.query("w6_dedup_window", _spaced_sql("user_id::varchar || '|' || event_type", "true", 86_400, "k as key, event_id"))
def w6_dedup_window(spark, sf_dir):
    """Events of a user and type accepted a day or more after the last accepted one."""
    rows = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return sessions.spaced(rows, "key", "event_id", "ts", 86_400).select("key", "event_id")


@_r.query("w18_delivery_limit", _spaced_sql("user_id", "event_type = 'error'", 5 * 3600, "user_id, event_id, ts"))
def w18_delivery_limit(spark, sf_dir):
    """Errors of a user reported at most once in five hours."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return sessions.spaced(rows, "user_id", "event_id", "ts", 5 * 3600).select("user_id", "event_id", "ts")


@_r.query(
    "w10_transitions",
    """with t as (select user_id, event_id, lag(event_type) over (partition by user_id order by event_id) as before, event_type as after from events)
select user_id, event_id, before, after, before is null or (before, after) in (('view', 'click'), ('click', 'purchase'), ('signup', 'view'), ('view', 'view')) as legal from t""",
)
def w10_transitions(spark, sf_dir):
    """Changes of a user's event type and whether a state machine allows them."""
    allowed = {"view": ("click", "view"), "click": ("purchase",), "signup": ("view",)}
    return sessions.transitions(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", allowed)


@_r.query(
    "w11_previous_version",
    "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 2",
)
def w11_previous_version(spark, sf_dir):
    """The last event but one of each user and type."""
    return sessions.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], 2).select("user_id", "event_type", "event_id", "value")


@_r.query("w19_latest_state", "select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by all")
def w19_latest_state(spark, sf_dir):
    """The last value of each user and type."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@_r.query(
    "w13_adjacent_copies",
    "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as b, row_number() over (partition by user_id order by event_id) as r from events) where r = 1 or event_type is distinct from b",
)
def w13_adjacent_copies(spark, sf_dir):
    """Events that differ in type from the one before."""
    return sessions.without_adjacent_copies(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type")


@_r.query(
    "w17_sampled_frames",
    "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) - 1 as r from events) where r % 5 = 0 and r < 50",
)
def w17_sampled_frames(spark, sf_dir):
    """Every fifth event of a user, ten at most."""
    return sessions.every_kth(table(spark, sf_dir, "events"), "user_id", ["event_id"], 5, 10).select("user_id", "event_id")


@_r.query(
    "w16_cron_due",
    """with e as (select date_trunc('minute', ts) as m from events), r as (select min(m) as low, max(m) as high from e),
d as (select unnest(generate_series(low, high, interval 1 minute)) as due from r)
select due, (select count(*) from e where e.m > due - interval 12 hour and e.m <= due) as n from d where minute(due) in (0, 30) and hour(due) in (6, 18)""",
)
def w16_cron_due(spark, sf_dir):
    """When a schedule of minutes and hours is due while there are events, and how many came in the twelve hours before."""
    at = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").groupBy(at.alias("at")).agg(F.count("*").alias("n"))
    ends = events.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    due = sessions.cron_due(str(ends["low"]), str(ends["high"]), (0, 30), (6, 18), spark)
    # events meet the times that are due by half days: those in which they come and the next
    half = lambda c: (F.unix_seconds(c) / 43_200).cast("long")
    asked = due.select("due", F.explode(F.array(half(F.col("due")) - 1, half(F.col("due")))).alias("half"))
    near = asked.join(events.withColumn("half", half(F.col("at"))), "half").where(F.expr("at > due - interval 12 hours and at <= due"))
    counted = due.join(near.groupBy("due").agg(F.sum("n").alias("n")), "due", "left")
    return counted.select(F.col("due").cast("timestamp_ntz").alias("due"), F.coalesce("n", F.lit(0)).alias("n"))


@_r.query(
    "w15_backoff",
    "select user_id, event_id, n, least(300.0, 2.0 * power(2.0, n - 1))::double as delay from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'error')",
)
def w15_backoff(spark, sf_dir):
    """The wait after each error of a user, doubling up to five minutes."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return sessions.backoff(rows, "n", 2.0, 2.0, 300.0).select("user_id", "event_id", "n", "delay")


def _seconds(column="ts"):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def _segments(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select("user_id", F.col("event_id").alias("pos"), _seconds().alias("start"), (_seconds() + 600).alias("end"), F.col("props").alias("text"), (F.col("value") / 1000).alias("confidence"))


_SEGMENTS = "s as (select user_id, event_id as pos, epoch(ts) as start, epoch(ts) + 600 as fin, props as text, value / 1000 as confidence from events where event_type = 'purchase')"


@_r.query(
    "j1_aligned_actions",
    "with " + _SEGMENTS + """, a as (select user_id, event_id as action_id, epoch(ts) as ts from events where event_type = 'error')
select a.user_id, a.action_id, a.ts, coalesce(string_agg(s.text, ' ' order by s.pos), '') as text, round(coalesce(avg(s.confidence), 0.0), 9) as confidence,
  coalesce(min(s.start), a.ts) as "start", coalesce(max(s.fin), a.ts) as "end", count(s.pos) as n_segments
from a left join s on a.user_id = s.user_id and not (s.fin < a.ts - 7200 or s.start > a.ts + 7200) group by a.user_id, a.action_id, a.ts""",
)
def j1_aligned_actions(spark, sf_dir):
    """Errors with the purchases of the same user within two hours."""
    actions = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("action_id"), _seconds().alias("ts"))
    return intervals.aligned(actions, _segments(spark, sf_dir), "user_id", 7200).withColumn("confidence", F.round("confidence", 9))


@_r.query(
    "j2_speakers",
    "with " + _SEGMENTS + """, w as (select user_id, event_id as word_id, epoch(ts) as start, epoch(ts) + 60 as fin from events where event_type = 'click'),
m as (select w.user_id, w.word_id, s.pos, s.text, least(w.fin, s.fin) - greatest(w.start, s.start) as o, s.start <= (w.start + w.fin) / 2 and (w.start + w.fin) / 2 <= s.fin as i
  from w join s on w.user_id = s.user_id and w.start <= s.fin and s.start <= w.fin),
b as (select user_id, word_id, (list(text order by o desc, pos) filter (where o > 0))[1] as x, (list(text order by pos desc) filter (where i))[1] as y from m group by all)
select w.user_id, w.word_id, coalesce(x, y, 'UNKNOWN') as speaker from w left join b using (user_id, word_id)""",
)
def j2_speakers(spark, sf_dir):
    """Clicks assigned to the purchase that they overlap most."""
    words = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.col("event_id").alias("word_id"), _seconds().alias("start"), (_seconds() + 60).alias("end"))
    speakers = _segments(spark, sf_dir).withColumnRenamed("text", "speaker")
    return intervals.assigned_speakers(words, speakers, "user_id", 600.0).select("user_id", "word_id", "speaker")


@_r.query(
    "j3_speaker_at",
    "with " + _SEGMENTS + """, p as (select user_id, event_id as point_id, epoch(ts) as at from events where event_type = 'view')
select p.user_id, p.point_id, coalesce((list(s.text order by s.pos) filter (where s.pos is not null))[1], 'UNKNOWN') as speaker
from p left join s on p.user_id = s.user_id and p.at between s.start and s.fin group by all""",
)
def j3_speaker_at(spark, sf_dir):
    """The first purchase span that contains each view."""
    points = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("point_id"), _seconds().alias("at"))
    spans = _segments(spark, sf_dir).withColumnRenamed("text", "speaker")
    return intervals.containing(points, spans, "user_id", 600.0, "speaker").select("user_id", "point_id", "speaker")


@_r.query(
    "j0_as_of_value",
    "select e.user_id, e.event_id, p.value as last_purchase from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) p on e.user_id = p.user_id and e.ts >= p.ts",
)
def j0_as_of_value(spark, sf_dir):
    """Errors with the value of the user's last purchase."""
    rows = table(spark, sf_dir, "events")
    errors = rows.where("event_type = 'error'").select("user_id", "event_id", "ts")
    bought = rows.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return intervals.as_of(errors, bought, "user_id", "ts", "last_purchase").select("user_id", "event_id", "last_purchase")


@_r.query("w3_word_windows", """
with recursive r as materialized (select user_id, epoch(ts) as t, event_type as x, row_number() over (partition by user_id order by ts, event_type) as n from events),
c as (select user_id, n, t, x, t as since, 0 as segment from r where n = 1
  union all select r.user_id, r.n, r.t, r.x, case when r.t - c.since >= 86400 then r.t else c.since end, c.segment + (r.t - c.since >= 86400)::int from c join r on r.user_id = c.user_id and r.n = c.n + 1)
select user_id, segment, min(t) as start, max(t) as "end", string_agg(x, ' ' order by n) as text, count(*) as n from c group by user_id, segment""")
def w3_word_windows(spark, sf_dir):
    """Events of a user put together in windows of a day from the first not yet in one."""
    rows = table(spark, sf_dir, "events").select("user_id", _seconds().alias("start"), _seconds().alias("end"), F.col("event_type").alias("text"))
    return sessions.fixed_windows(rows, "user_id", "start", "end", "text", 86_400.0)


@_r.query("a3_network_summary", "select count(*) as total, count(*) filter (where event_type = 'error') as errors, round(avg((event_type = 'error')::int), 6) as error_rate, round(avg(value), 6) as mean_value from events")
def a3_network_summary(spark, sf_dir):
    """Totals, errors and their rate."""
    bad = (F.col("event_type") == "error").cast("int")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.sum(bad).alias("errors"), F.round(F.avg(bad), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean_value"))


@_r.query(
    "o9_unreleased_keys",
    "with g as (select user_id, list_distinct(list(props) filter (where event_type = 'click')) as d, list_distinct(list(props) filter (where event_type = 'view')) as u, count(*) filter (where event_type = 'signup') as n from events group by user_id) select user_id, list_sort(list_filter(coalesce(d, []), lambda x: not list_contains(coalesce(u, []), x))) as held, n as n_open from g",
)
def o9_unreleased_keys(spark, sf_dir):
    """Targets clicked and never viewed, as keys pressed and never released."""
    of = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.col("props")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.array_sort(F.array_except(of("click"), of("view"))).alias("held"), F.count_if(F.col("event_type") == "signup").alias("n_open")
    )
