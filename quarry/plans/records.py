"""Queries on traces, archives and connectors: a table is written in a source's format and read back."""

from __future__ import annotations

import json
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import evaluate, graph, packs
from quarry.plans._registry import Registry
from quarry.session import shared_dir, table
from quarry.sources import connectors, readers, sinks, variants
from quarry.streaming import events as streams

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _lines(rows: DataFrame) -> DataFrame:
    """The texts of a frame (value) written as files of lines and read again."""
    path = f"{shared_dir(rows.sparkSession)}/lines-{uuid.uuid4().hex[:12]}"
    rows.write.text(path)
    return variants.texts(rows.sparkSession, path)


_DAYS = "select event_id, event_type, value, props, user_id, user_id || ':' || strftime(ts, '%Y-%m-%d') as session, row_number() over (partition by user_id, ts::date order by event_id) - 1 as position from events"


@_r.query("s18_traces", f"select session, position::int as position, event_type as action_type, '#u' || user_id as target_selector, event_id::varchar as value, json_extract_string(props, '$.k')::int as k from ({_DAYS})")
def s18_traces(spark, sf_dir):
    """Each user's day as a recorded session, a line of JSON among broken ones; its actions with a field of their
    nested metadata."""
    e = table(spark, sf_dir, "events")
    session = F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    action = F.struct(F.col("event_type").alias("type"), F.concat(F.lit("#u"), "user_id").alias("selector"), F.col("event_id").alias("value"), F.struct(F.from_json("props", "k int").alias("props")).alias("more"))
    days = e.groupBy(session.alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", action.alias("a")))), lambda x: x["a"]).alias("actions"))
    lines = days.select(F.to_json(F.struct(F.col("s").alias("start_url"), "actions")).alias("value"))
    found = variants.trace_actions(_lines(lines.union(spark.createDataFrame([("{broken",), ("[]",), ('{"actions": 3}',)], "value string"))))
    return found.select(F.col("start_url").alias("session"), "position", "action_type", "target_selector", "value", variants.get(F.col("metadata"), "$.more.props.k", "int").alias("k"))


@_r.query("s18_archives", "select url, 'GET' as method, 200 as status, octet_length(encode(coalesce(html, '')))::bigint as bytes, (page_id % 7) * 0.5::double as milliseconds from pages where url is not null")
def s18_archives(spark, sf_dir):
    """Pages as the entries of HTTP archives, fifty each."""
    entry = F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("startedDateTime"), F.struct(F.lit("GET").alias("method"), "url").alias("request"), ((F.col("page_id") % 7) * 0.5).alias("time"),
        F.struct(F.lit(200).alias("status"), F.struct(F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), F.lit("text/html").alias("mimeType")).alias("content")).alias("response"),
    )
    packed = table(spark, sf_dir, "pages").where("url is not null").groupBy(F.expr("page_id div 50")).agg(F.collect_list(entry).alias("entries"))
    found = variants.har_entries(_lines(packed.select(F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value"))))
    return found.select("url", "method", "status", "bytes", "milliseconds")


@_r.query("s18_leaves", """
select page_id, 'host' as path, coalesce(regexp_extract(url, '://([^/]*)', 1), '') as value from pages union all select page_id, 'parts[0].n', page_id::varchar from pages
union all select page_id, 'parts[1][0]', '' from pages union all select page_id, 'parts[1][1]', 'true' from pages""")
def s18_leaves(spark, sf_dir):
    """Pages as nested JSON, opened to the last level."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.regexp_extract("url", "://([^/]*)", 1), F.lit("")).alias("host"))
    text = F.concat(F.lit('{"host":'), F.to_json(F.array("host")).substr(F.lit(2), F.length(F.to_json(F.array("host"))) - 2), F.lit(',"parts":[{"n":'), F.col("page_id"), F.lit('},[null,true],[],{}]}'))
    return variants.leaves(variants.parsed(rows.withColumn("t", text), "t"), "v", "page_id")


@_r.query("s14_vendor_records", """
select 'D-' || doc_id as record_id, lang as title, text as content, 'http://h/' || doc_id as source_url, 'jira' as source_type, source as detail from documents
union all select doc_id::varchar, lang, text, 'http://h/' || doc_id, 'github_issues', source from documents
union all select doc_id::varchar, lang, text, 'http://h/' || doc_id, 'slack', null from documents""")
def s14_vendor_records(spark, sf_dir):
    """All documents as pages of three vendors' interfaces, twenty records a page, mapped to records."""
    docs = table(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("http://h/"), "doc_id"))
    block = F.struct(F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"))).alias("content"))
    fields = F.struct(F.col("lang").alias("summary"), block.alias("description"), F.struct(F.col("source").alias("name")).alias("status"))
    shapes = {
        "jira": ("issues", F.struct(F.concat(F.lit("D-"), "doc_id").alias("key"), F.col("url").alias("self"), fields.alias("fields"))),
        "github_issues": (None, F.struct(F.col("doc_id").alias("number"), F.col("lang").alias("title"), F.col("text").alias("body"), F.col("url").alias("html_url"), F.col("source").alias("state"))),
        "slack": ("messages", F.struct(F.col("doc_id").cast("string").alias("ts"), F.col("lang").alias("user"), "text", F.col("url").alias("permalink"))),
    }
    out = []
    for vendor, (name, record) in shapes.items():
        page = docs.groupBy(F.expr("doc_id div 20")).agg(F.collect_list(record).alias("r"))
        found = variants.vendor_records(_lines(page.select(F.to_json(F.struct(F.col("r").alias(name)) if name else F.col("r")).alias("value"))), vendor)
        out.append(found.withColumn("detail", F.coalesce(F.try_element_at("metadata", F.lit("status")), F.try_element_at("metadata", F.lit("state")))).drop("metadata"))
    return connectors.union(*out)


@_r.query("s10_database", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 1000 and o_orderstatus <> 'P'")
def s10_database(spark, sf_dir):
    """Orders loaded into a database from files that tasks wrote, and read from it in parts by all executors, filters and
    columns being its own work."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    url, options = sinks.database(rows, f"{shared_dir(spark)}/database-{uuid.uuid4().hex[:12]}", "orders", {"o_orderstatus": "VARCHAR(8)"})
    held = readers.jdbc_partitioned(spark, url, "orders", "o_orderkey", 6, **options)
    return held.where("o_totalprice > 1000 and o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice")


PAGE, SHARES = 200, 4


@_r.query("s15_connector", f"select event_id::varchar as record_id, event_type as title, 'pages' as source_type, (event_id // {SHARES} // {PAGE})::varchar as page from events")
def s15_connector(spark, sf_dir):
    """Events written as pages of four shares, half of them before a stream reads them to the end, half before
    it goes on from where it stopped."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not know this module's path
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex[:12]}"
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((e % SHARES).alias("share"), F.expr(f"event_id div {SHARES} div {PAGE}").alias("page"), e.cast("string").alias("record_id"), F.col("event_type").alias("title"))
    half = (rows.agg(F.max("page")).first()[0] or 0) // 2 + 1
    spark.dataSource.register(connectors.paged("pages", _page_of, _pages_held))
    from quarry.plans.files import _written

    packed = rows.groupBy("share", "page").agg(F.array_join(F.collect_list(F.to_json(F.struct("record_id", "title"))), "\n").alias("value"))
    for part in (F.col("page") < half, F.col("page") >= half):
        _written(packed.where(part).select(F.format_string("share=%d/page=%d", "share", "page").alias("file"), "value"), "jsonl", f"{folder}/in")
        stream = spark.readStream.format("pages").option("folder", f"{folder}/in").option("shares", str(SHARES)).load()
        streams.stored(stream, f"{folder}/out", f"{folder}/state")
    found = spark.read.schema(connectors.RECORD).parquet(f"{folder}/out")
    return found.select("record_id", "title", "source_type", F.col("metadata")["page"].alias("page"))


def _store(options: dict[str, str]):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(options["folder"] if "://" in options["folder"] or options["folder"].startswith("/") else options["folder"].replace("file:", "file://", 1))
    return store, f"{root}/share={options['share']}"


def _pages_held(options: dict[str, str]) -> int:
    """How many pages a share has."""
    from pyarrow import fs

    store, share = _store(options)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(share, allow_not_found=True))]
    return max((int(x.removeprefix("page=").removesuffix(".jsonl")) + 1 for x in names if x.startswith("page=")), default=0)


def _page_of(options: dict[str, str], number: int) -> list[dict]:
    """The records of a page."""
    store, share = _store(options)
    try:
        held = store.open_input_stream(f"{share}/page={number}.jsonl")
    except FileNotFoundError:
        return []
    with held:
        return [json.loads(x) | {"metadata": {"page": number}} for x in held.read().decode().split("\n") if x]


_SAID = r"([a-zA-Z][a-zA-Z0-9_\-]+)\s+(is|has|uses|contains|belongs_to|related_to|part_of)\s+([a-zA-Z][a-zA-Z0-9_\-]+)"


@_r.query("f34_said_triples", " union all ".join([rf"""select doc_id, unnest(range(len(s)))::int as position, lower(unnest(s)) as subject, lower(unnest(p)) as predicate, lower(unnest(o)) as object, 0.85::double as confidence
from (select doc_id, regexp_extract_all(text, '(?i){_SAID}', 1) as s, regexp_extract_all(text, '(?i){_SAID}', 2) as p, regexp_extract_all(text, '(?i){_SAID}', 3) as o from documents)"""]))
def f34_said_triples(spark, sf_dir):
    """Relations that all documents state between two words."""
    return graph.said(table(spark, sf_dir, "documents"), "text", "doc_id")


@_r.query("f45_markdown_rows", r"""
select c_custkey, '| ' || c_custkey || ' | a\|' || c_name || ' | ' || case when c_custkey % 2 = 0 then c_mktsegment else '' end || ' |' as line,
  '**name**: ' || c_name || case when c_custkey % 2 = 0 then chr(10) || '**segment**: ' || c_mktsegment else '' end as fields from customer""")
def f45_markdown_rows(spark, sf_dir):
    """Customers as rows of a table in markdown, and as fields."""
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    line = readers.markdown_line(F.col("c_custkey"), F.concat(F.lit("a|"), "c_name"), segment)
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"), readers.key_value_lines({"name": F.col("c_name"), "segment": segment}).alias("fields"))


@_r.query("f53_steps", """
with r as (select event_id, case event_type when 'click' then 'click' when 'view' then 'navigate' when 'purchase' then 'type' else event_type end as kind, '#u' || user_id as s, 'it''s ' || event_id as v from events)
select event_id, kind, case when kind <> 'navigate' then s end as selector, case when kind in ('navigate', 'type') then v end as value from r""")
def f53_steps(spark, sf_dir):
    """Events as steps of a script, written as text and parsed again."""
    kind = F.when(F.col("event_type") == "view", "navigate").when(F.col("event_type") == "purchase", "type").otherwise(F.col("event_type"))
    text = packs.step_text(kind, F.concat(F.lit("#u"), "user_id"), F.concat(F.lit("it's "), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", packs.parsed_step(text).alias("s")).select("event_id", "s.*")


@_r.query("c12_step_reports", """
with r as (select user_id, ts::date as day, event_id, event_type <> 'error' as ok from events), f as (select user_id, day, min(event_id) filter (where not ok) as failed_at from r group by all)
select user_id, day, count(*) as n_steps, count(*) filter (where failed_at is null or event_id < failed_at) as n_passed, count(*) filter (where event_id > failed_at) as n_skipped, failed_at, failed_at is null as success
from r join f using (user_id, day) group by user_id, day, failed_at""")
def c12_step_reports(spark, sf_dir):
    """Each user's day as a replay that ends at its first error."""
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return evaluate.step_report(evaluate.step_statuses(rows, ["user_id", "day"], "event_id", "ok"), ["user_id", "day"], "event_id")


@_r.query("c21_session_history", """
with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as seq, count(*) over (partition by user_id) as n from events)
select user_id, seq, event_id, event_type from r where seq > n - 10""")
def c21_session_history(spark, sf_dir):
    """The last ten entries of each user's history with their numbers."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    counts = rows.groupBy("user_id").agg(F.count("*").alias("n"))
    kept = rows.withColumn("_back", last).where(F.col("_back") <= 10).join(counts, "user_id")
    return kept.select("user_id", (F.col("n") - F.col("_back") + 1).alias("seq"), "event_id", "event_type")


@_r.query("s20_watched", "select sha256(text || chr(10)) as sha256, octet_length(encode(text || chr(10)))::bigint as size, text || chr(10) as text, cast(null as varchar) as error from benchmark")
def s20_watched(spark, sf_dir):
    """Items that come into a folder as files, half of them before a stream looks, half before it looks again; files of
    other suffixes are passed over."""
    from quarry.plans.files import _written

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.col("text").alias("value"))
    folder = f"{shared_dir(spark)}/watched-{uuid.uuid4().hex[:12]}"
    for part, suffix in ((F.col("file") % 2 == 0, "md"), (F.col("file") % 3 == 0, "tmp"), (F.col("file") % 2 == 1, "txt")):
        _written(rows.where(part), suffix, folder)
        if suffix != "tmp":
            streams.stored(readers.watched(spark, folder, ("md", "txt")), f"{folder}-out", f"{folder}-state")
    return spark.read.schema("size long, sha256 string, text string, error string").parquet(f"{folder}-out").select("sha256", "size", "text", "error")
