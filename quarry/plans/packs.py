"""Queries on packs, streams and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import governance, packs
from quarry.plans._registry import Registry
from quarry.session import table
from quarry.sources import robots, sinks
from quarry.streaming import events as streams

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _grams(spark, sf_dir):
    from quarry.plans.events import a10_action_ngrams

    return a10_action_ngrams(spark, sf_dir)


@_r.query("c8_workflow_packs")
def c8_workflow_packs(spark, sf_dir):
    """Packs of the procedures that users' events show."""
    return packs.workflow_packs(_grams(spark, sf_dir), "gram")


@_r.query("c9_eval_cases")
def c9_eval_cases(spark, sf_dir):
    return packs.eval_cases(c8_workflow_packs(spark, sf_dir))


@_r.query("c14_conversation_packs", """
select conv_id, len(list(turn))::int as n_steps, list_transform(list({'turn': turn, 'role': role} order by turn), lambda x: case x.role when 'user' then 'ask' when 'system' then 'instruct' else 'answer' end) as actions from conversations group by conv_id""")
def c14_conversation_packs(spark, sf_dir):
    found = packs.conversation_packs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "n_steps", F.transform("steps", lambda s: s["action"]).alias("actions"))


@_r.query("c10_receipts")
def c10_receipts(spark, sf_dir):
    """Receipts of users' runs: kinds of events stand for signals."""
    names = {"view": "acquire.completed", "click": "normalize.completed", "signup": "chunk.completed", "purchase": "pack.completed", "error": "eval.completed"}
    signal = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    rows = table(spark, sf_dir, "events").withColumns(
        {"signal": F.try_element_at(signal, F.col("event_type")), "rights": F.when(F.col("event_id") % 3 == 0, "approved").otherwise("pending"), "rate": F.col("event_id") % 100 / 100}
    )
    return packs.receipts(rows, "user_id", "event_id", "signal", "rights", "rate", F.col("event_id") % 2 == 0, F.col("event_id") % 5 == 0)


@_r.query("c11_demoted", """
with p as (select l_orderkey, any_value(case when l_orderkey % 3 = 0 then 'demoted' else 'promoted' end) as before, bool_or(l_partkey not in (select p_partkey from part where p_size > 2)) as lost from lineitem group by l_orderkey)
select l_orderkey, before, case when before = 'promoted' and lost then 'demoted' when before = 'demoted' and not lost then 'promoted' else before end as after from p""")
def c11_demoted(spark, sf_dir):
    """Orders as packs that lose or regain their status with the registry of their parts."""
    rows = table(spark, sf_dir, "lineitem").withColumn("status", F.when(F.col("l_orderkey") % 3 == 0, "demoted").otherwise("promoted"))
    registry = table(spark, sf_dir, "part").where("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    return packs.demoted(rows, registry, "l_orderkey", "l_partkey", "status")


@_r.query("c15_specialised_packs", "select c_custkey, list_sort(list_distinct(['base', c_mktsegment])) as tags, case when c_nationkey < 5 then 'strict' else 'open' end as mode from customer")
def c15_specialised_packs(spark, sf_dir):
    """A template put under each customer's own settings."""
    own = F.when(F.col("c_nationkey") < 5, F.create_map(F.lit("mode"), F.lit("strict"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = table(spark, sf_dir, "customer").withColumn("own", own).withColumn("base", F.create_map(F.lit("mode"), F.lit("open")))
    made = governance.overridden(F.col("base"), F.col("own"))
    return rows.select("c_custkey", F.array_sort(F.array_union(F.array(F.lit("base")), F.array("c_mktsegment"))).alias("tags"), made["mode"].alias("mode"))


@_r.query("w4_merged_scrolls", f"""
with recursive r as materialized (select user_id, event_id, epoch_us(ts) / 1e10::double as s, case when event_type = 'view' then 'scroll' else event_type end as kind, coalesce(value % 90 - 40, 0)::double as d, row_number() over (partition by user_id order by ts, event_id) as n from events),
c as (select user_id, n, event_id, kind, d as total, s, 0 as step from r where n = 1
  union all select user_id, n, event_id, kind, case when joins then before + d else d end, s, step + (not joins)::int
  from (select r.*, c.total as before, c.step, r.kind = 'scroll' and c.kind = 'scroll' and r.s - c.s <= {packs.SCROLL_SECONDS} and abs(r.d) <= {packs.SCROLL_PX} and c.total * r.d >= 0 as joins from c join r on r.user_id = c.user_id and r.n = c.n + 1))
select user_id, step::int as step, min(kind) as kind, arg_max(total, n) as delta, arg_min(event_id, n) as first, arg_max(event_id, n) as last, count(*)::int as n from c group by user_id, step""")
def w4_merged_scrolls(spark, sf_dir):
    """Views as scrolls: runs within half a second, of one direction, as a step."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e10).alias("s"), F.when(F.col("event_type") == "view", "scroll").otherwise(F.col("event_type")).alias("kind"), (F.col("value") % 90 - 40).alias("dy")
    )
    return packs.merged_scrolls(rows, "user_id", "event_id", "s", "kind", "dy")


@_r.query("f52_action_types", "select event_id, case when event_type = 'click' then 'click' else 'unknown' end as action_type, case when event_type = 'click' then 'click ' || props else event_type || ' ' || props end as step from events")
def f52_action_types(spark, sf_dir):
    action = F.concat(F.initcap("event_type"), F.lit(": "), F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", packs.action_type(action).alias("action_type"), packs.step_text(F.col("event_type"), F.col("props"), F.lit(None).cast("string")).alias("step"))


@_r.query("f54_templates", "select c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || '.' as message from customer")
def f54_templates(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", governance.template("Dear {{name}} of {{segment}}{{missing}}.", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("message"))


@_r.query("f51_migrations", "select p_partkey, list_filter([case when p_size % 4 < p_size % 3 then 'rights loosened' end, case when p_size % 5 > 2 and p_size % 2 = 0 then 'removal without major version' end], lambda x: x is not null) as errors from part")
def f51_migrations(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", governance.migration_errors(s % 3, s % 4, F.when(s % 5 > 2, 1).otherwise(0), F.when(s % 2 == 0, "minor").otherwise("major")).alias("errors"))


@_r.query("f63_redaction_flags", "select p_partkey, list_filter([case when p_size > 40 then 'pii' end, case when p_size % 2 = 0 then 'secrets' end], lambda x: x is not null) as flags, p_size > 40 and p_size % 2 = 0 as all_set from part")
def f63_redaction_flags(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("p_size") > 40, "pii"), F.when(F.col("p_size") % 2 == 0, "secrets")))
    checks = F.array(F.col("p_size") > 40, F.col("p_size") % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", flags.alias("flags"), F.forall(checks, lambda c: c).alias("all_set"))


@_r.query("f60_dates", "select event_id, ts from events where event_id % 2 = 0")
def f60_dates(spark, sf_dir):
    """Times read back from text; what is none is passed over."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise("not a date")
    rows = table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text).alias("ts"))
    return rows.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_r.query("a9_step_taxonomy")
def a9_step_taxonomy(spark, sf_dir):
    """A taxonomy of the benchmark's sentences, an item being a pack."""
    from quarry.functions import text as T

    steps = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.sentences(F.col("text"))).alias("step"))
    return packs.step_taxonomy(steps, "item_id", "step")


@_r.query("o10_line_diff", "select p_partkey, ['- b' || p_size, '+ c' || p_size, '  a'] as diff from part")
def o10_line_diff(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", packs.line_diff(F.concat(F.lit("a\nb"), size), F.concat(F.lit("a\nc"), size)).alias("diff"))


@_r.query("o8_changed_keys", "select p_partkey, list_filter(['a', case when p_size % 2 = 0 then 'b' end, 'c'], lambda x: x is not null) as changed from part")
def o8_changed_keys(spark, sf_dir):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.create_map(F.lit("b"), F.when(F.col("p_size") % 2 == 0, "3").otherwise("2"), F.lit("c"), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", packs.changed_keys(old, new).alias("changed"))


@_r.query("o2_artifact_sets", "with a as (select o_orderpriority as k, list(distinct o_custkey) as x from orders where o_orderstatus = 'F' group by 1), b as (select o_orderpriority as k, list(distinct o_custkey) as y from orders where o_orderstatus = 'O' group by 1) select k as o_orderpriority, list_sort(list_filter(x, lambda v: not list_contains(y, v))) as removed, list_sort(list_filter(y, lambda v: not list_contains(x, v))) as added from a join b using (k)")
def o2_artifact_sets(spark, sf_dir):
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_custkey")))
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(pick("F").alias("x"), pick("O").alias("y"))
    return rows.select("o_orderpriority", F.array_sort(F.array_except("x", "y")).alias("removed"), F.array_sort(F.array_except("y", "x")).alias("added"))


@_r.query("o6_unified_records", "select doc_id as record_id, 'documents' as source_type, lang from documents union all select page_id, 'pages', null from pages union all select item_id, 'benchmark', null from benchmark")
def o6_unified_records(spark, sf_dir):
    from quarry.sources.connectors import union

    rows = lambda name, key, *more: table(spark, sf_dir, name).select(F.col(key).alias("record_id"), F.lit(name).alias("source_type"), *more)
    return union(rows("documents", "doc_id", "lang"), rows("pages", "page_id"), rows("benchmark", "item_id"))


@_r.query("k11_handoff", "with p as (select p_partkey, case when p_size % 2 = 0 then 'promoted' else 'draft' end as status, p_brand as pack_type from part), s as (select s_name as agent, 'Brand#' || (s_suppkey % 5 + 1)::varchar || '1' as b from supplier) select p_partkey, status, pack_type, coalesce(list_sort(list(distinct agent) filter (where agent is not null)), []) as agents from p left join s on b = pack_type where status = 'promoted' group by all")
def k11_handoff(spark, sf_dir):
    """Promoted parts with the suppliers subscribed to their brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "promoted").otherwise("draft").alias("status"), F.col("p_brand").alias("pack_type"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("1"))
    subs = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("agent"), F.array(brand).alias("pack_types"))
    return sinks.handoff(parts, subs, "status", "pack_type")


@_r.query("k12_content_store", "with h as (select doc_id, sha256(text) as sha256 from documents), f as (select sha256, min(doc_id) as doc_id from h group by 1) select doc_id, sha256, 'objects/' || substr(sha256, 1, 2) || '/' || sha256 as path from f where sha256 not in (select sha256(text) from benchmark)")
def k12_content_store(spark, sf_dir):
    """What a store that holds the benchmark takes in of the documents."""
    held = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"))
    return sinks.put(table(spark, sf_dir, "documents"), held, "text", "doc_id").select("doc_id", "sha256", "path")


@_r.query("k2_markdown_rows", "select '| ' || c_custkey || ' | ' || replace(c_name, '|', '\\|') || ' | ' || c_mktsegment || ' |' as line from customer")
def k2_markdown_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(sinks.markdown_row(["c_custkey", "c_name", "c_mktsegment"]).alias("line"))


@_r.query("k4_wire_lines", "select 'data: {\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' || chr(10) || chr(10) as line from nation")
def k4_wire_lines(spark, sf_dir):
    return sinks.wire(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "sse")


@_r.query("k13_cached_values", "select doc_id, length(text)::int as v from documents")
def k13_cached_values(spark, sf_dir):
    """Values by hash of text: those of English texts cached, others computed once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    value = lambda rows: rows.withColumn("v", F.length("text"))
    cache = value(docs.where("lang = 'en'").select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"]))
    return sinks.cached(docs, cache, "text", value, "v").select("doc_id", "v")


@_r.query("p10_robots")
def p10_robots(spark, sf_dir):
    """Pages' urls against robots files of their hosts, which close one language."""
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()
    files = hosts.select("host", F.when(F.col("host").startswith("m."), F.lit("User-agent: *\nDisallow: /fr/\nAllow: /fr/1\n")).otherwise(F.lit("User-agent: *\nDisallow: /*.html$\n")).alias("content"))
    return robots.judged(pages, robots.rules(files), "url", "bot")


ORACLES["p10_robots"] = r"select distinct url, not (case when starts_with(h, 'm.') then starts_with(p, '/fr/') and not starts_with(p, '/fr/1') else regexp_matches(p, '^/.*\.html$') end) as allowed from (select url, regexp_extract(url, '://([^/?#]*)', 1) as h, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as p from pages)"


@_r.query("t7_reranked", """
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0), d as (select vec_id as id, embedding::double[] as v from embeddings),
s as (select query_id, id, list_cosine_similarity(q.v, d.v) as score from q, d), k as (select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, id desc) as r from s)
select query_id, id, score, (row_number() over (partition by query_id order by -id desc, r))::int as rank from k where r <= 10 qualify rank <= 3""")
def t7_reranked(spark, sf_dir):
    """The ten nearest ordered anew by another score."""
    from quarry.plans.similarity import t1_cosine_knn

    return packs.reranked(t1_cosine_knn(spark, sf_dir), "query_id", -F.col("id"), 3)


@_r.query("j13_all_promoted", "select count(*) as unknown from (select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier))")
def j13_all_promoted(spark, sf_dir):
    """How many suppliers lines name that there are not."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    return lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(F.count("*").alias("unknown"))


@_r.query("j12_enriched_rows", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j12_enriched_rows(spark, sf_dir):
    """Customers with their nation and region; both are small, and Spark broadcasts them while they are."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@_r.query("r3_stream_windows", "select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n from events group by all")
def r3_stream_windows(spark, sf_dir):
    """Events replayed as a stream: counts by day and kind."""
    return _drained(spark, streams.tumbling(_stream(spark, sf_dir), "ts", "1 day", "1 hour", "event_type"), "r3", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@_r.query("r5_stream_sessions", """
with m as (select *, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as n from events window w as (partition by user_id order by ts)),
s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as s from m)
select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) as n from s group by user_id, s""")
def r5_stream_sessions(spark, sf_dir):
    """Events replayed as a stream: sessions that six hours of silence end."""
    out = _drained(spark, streams.sessions(_stream(spark, sf_dir), "ts", "6 hours", "1 hour", "user_id"), "r5", "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@_r.query("r6_stream_dedup", "select count(*) as n from (select distinct user_id, event_type from events)")
def r6_stream_dedup(spark, sf_dir):
    """Events replayed as a stream: the first of each user and kind within a long delay."""
    return _drained(spark, streams.deduplicated(_stream(spark, sf_dir), "ts", "365 days", "user_id", "event_type"), "r6", "append").agg(F.count("*").alias("n"))


@_r.query("r4_stream_alerts", "with w as (select unnest([time_bucket(interval 1 day, ts), time_bucket(interval 1 day, ts) + interval 12 hour, time_bucket(interval 1 day, ts) - interval 12 hour]) as start, ts, event_type from events) select start, start + interval 1 day as \"end\", event_type, count(*) as n from w where ts >= start and ts < start + interval 1 day group by all having count(*) >= 10")
def r4_stream_alerts(spark, sf_dir):
    """Events replayed as a stream: sliding days with ten events of a kind."""
    out = _drained(spark, streams.sliding_alerts(_stream(spark, sf_dir), "ts", "1 day", "12 hours", "1 hour", 10, "event_type"), "r4", "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream, name, mode):
    import uuid

    from quarry.session import shared_dir

    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    return streams.stored(stream, f"{folder}/out", f"{folder}/state", mode)
