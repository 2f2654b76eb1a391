"""Queries on sources and sinks: a table is written to the shared folder in a format and read back by its reader."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import governance, redaction
from quarry.plans._registry import Registry
from quarry.sources import readers, sinks
from quarry.session import shared_dir, table
from quarry.streaming import events as streams

_r = Registry()
QUERIES, ORACLES = _r.queries, _r.oracles


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{name}-{uuid.uuid4().hex[:12]}"


def _written(lines: DataFrame, suffix: str, path: str | None = None) -> str:
    """The folder of text files of a suffix that a frame of lines (value) is written to; names are changed through
    Spark's own file system. With a column `file`, a key, each row is a file of that name (folders and all)."""
    spark = lines.sparkSession
    path = path or _folder(spark, suffix)
    if "file" in lines.columns:
        _one_each(lines, suffix, path)
        return path
    lines.write.mode("append").text(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = fs.listFiles(root, True)
    while listed.hasNext():
        found = listed.next().getPath()
        if found.getName().startswith("part-") and "c000." in found.getName():
            fs.rename(found, jvm.org.apache.hadoop.fs.Path(found.getParent(), f"{found.getName()[:10]}.{suffix}"))
    return path


def _one_each(lines: DataFrame, suffix: str, path: str) -> None:
    """Each row (file, value) as a file of a folder, by the tasks themselves: a table's share of small files would be moved
    one by one by the driver, were it Spark's commit. A file takes its name when it is whole, so a task may run again."""
    uri = path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        made, n = set(), 0
        for batch in batches:
            for name, value in zip(batch["file"].to_pylist(), batch["value"].to_pylist(), strict=True):
                folder, _, base = f"{root}/{name}.{suffix}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                part = f"{folder}/.{base}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(f"{value or ''}\n".encode())
                store.move(part, f"{folder}/{base}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    dealt = lines.select(F.col("file").cast("string").alias("file"), "value").repartition(lines.sparkSession.sparkContext.defaultParallelism)
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


@_r.query("s1_json_files", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def s1_json_files(spark, sf_dir):
    """Customers as a JSON array in a file for each nation, read as whole files."""
    rows = table(spark, sf_dir, "customer")
    arrays = rows.groupBy(F.col("c_nationkey").alias("file")).agg(F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))).alias("value"))
    return readers.json_documents(spark, _written(arrays, "json")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@_r.query("s2_json_lines", "select event_id, user_id, event_type, value from events")
def s2_json_lines(spark, sf_dir):
    """Events as JSON lines among bad ones, which are dropped."""
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"))
    bad = spark.createDataFrame([("{broken",), ("",), ('{"event_id": "x',)], "value string")
    path = _written(lines.union(bad), "jsonl")
    return readers.json_lines(spark, path, False, "event_id long, user_id long, event_type string, value double").where("event_id is not null")


@_r.query("s3_flattened_rows", """
select p_partkey, unnest(['name', 'brand.id', 'brand.sizes[0]', 'brand.sizes[1]', 'none']) as key, unnest([p_name, p_brand, p_size::varchar, (p_size + 1)::varchar, '']) as value from part""")
def s3_flattened_rows(spark, sf_dir):
    """Parts as nested JSON, flattened to dotted keys."""
    size = F.col("p_size")
    nested = F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("id"), F.array(size, size + 1).alias("sizes")).alias("brand"), F.lit(None).cast("string").alias("none"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_json(nested, {"ignoreNullFields": "false"}).alias("json"))
    return readers.with_flattened(rows, "json").select("p_partkey", F.explode("flat").alias("key", "value"))


@_r.query("s5_csv_rows", "select p_partkey::varchar as p_partkey, p_name || ', \"' || p_brand || '\"' as name, p_size::varchar as p_size from part")
def s5_csv_rows(spark, sf_dir):
    """Parts as CSV, with commas and quotes in names."""
    path = _folder(spark, "csv")
    name = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_size").write.option("header", True).option("escape", '"').csv(path)
    return readers.csv_table(spark, path)


@_r.query("s7_mailbox", "select 'm' || conv_id || '.' || turn || '@x' as message_id, 'turn ' || turn as subject, role as sender, ['a@x', 'b@x'] as recipients, turn % 7 as kind from conversations")
def s7_mailbox(spark, sf_dir):
    """Messages as a mailbox; `kind` stands in the body."""
    rows = table(spark, sf_dir, "conversations")
    body = F.format_string("From %s@x Mon Jan 1\nMessage-ID: <m%d.%d@x>\nSubject: turn %d\nFrom: %s\nTo: a@x, b@x\n\nkind %d\n>From here on nothing\n", "role", "conv_id", "turn", "turn", "role", F.col("turn") % 7)
    found = readers.mails(spark, _written(rows.select(body.alias("value")), "mbox"))
    kind = F.regexp_extract("text", "kind (\\d+)\nFrom here on nothing$", 1).cast("long").alias("kind")
    return found.select(F.translate("message_id", "<>", "").alias("message_id"), "subject", "sender", "recipients", kind)


_ITEMS = "select sha256(text || chr(10)) as sha256, octet_length(encode(text || chr(10))) as size, 'document' as kind from benchmark"


@_r.query("s8_files", _ITEMS)
def s8_files(spark, sf_dir):
    """Benchmark items as files: hash, size and kind by suffix."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.col("text").alias("value"))
    return readers.files(spark, _written(items, "md"), "*.md").select("sha256", "size", "kind")


_TEXT = r"regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<head.*?</head>|<[^>]+>', ' ', 'g')"
for _entity, _char in (("middot", "\u00b7"), ("copy", "\u00a9"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    _TEXT = f"replace({_TEXT}, '&{_entity};', '{_char}')"


@_r.query("s9_normalised", f"select trim(regexp_replace({_TEXT}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as text, cast(null as varchar) as error from pages where html is not null")
def s9_normalised(spark, sf_dir):
    """Pages as files of a folder, normalised to text."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    path = _written(pages.select(F.col("page_id").alias("file"), F.col("html").alias("value")), "html")
    return readers.documents(spark, path, "*.html").select("text", "error")


@_r.query("s11_object_store", "select text || chr(10) as text from benchmark")
def s11_object_store(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file"), F.col("text").alias("value"))
    return readers.object_store(spark, _written(items, "md"), ("md", "txt")).select("text")


#: Items of a feed, entries of a sitemap.
PACK = 100


@_r.query("s13_feed", f"select (row_number() over (partition by p_partkey // {PACK} order by p_partkey) - 1)::int as position, p_name as title, 'http://h/' || p_partkey as link, 'day ' || p_size as published, p_brand || ' & ' || p_type as summary from part")
def s13_feed(spark, sf_dir):
    """Parts as the items of feeds of a hundred."""
    item = F.format_string("<item><title> %s</title><link>http://h/%d</link><pubDate>day %d</pubDate><description>&lt;b&gt;%s&lt;/b&gt; &amp;amp; %s</description></item>", "p_name", "p_partkey", "p_size", "p_brand", "p_type")
    items = table(spark, sf_dir, "part").groupBy(F.expr(f"p_partkey div {PACK}").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))).alias("i"))
    feed = F.concat(F.lit('<rss version="2.0"><channel><title>parts</title>'), F.array_join(F.transform("i", lambda v: v["x"]), ""), F.lit("</channel></rss>"))
    return readers.feeds(spark, _written(items.select("file", feed.alias("value")), "xml")).select("position", "title", "link", "published", "summary")


@_r.query("s16_sitemap", "select 'url' as kind, 'http://h/' || c_custkey as loc, case when c_custkey % 3 = 0 then '2024-01-01' end as lastmod, case when c_custkey % 4 = 0 then 0.5 else (c_custkey % 10) / 10.0 end::double as priority from customer")
def s16_sitemap(spark, sf_dir):
    """Customers as the entries of sitemaps of a hundred, some without date or priority."""
    key = F.col("c_custkey")
    entry = F.concat(
        F.lit("<url><loc> http://h/"), key, F.lit("</loc>"), F.when(key % 3 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""),
        F.when(key % 4 == 0, F.when(key % 8 == 0, "<priority>high</priority>").otherwise("")).otherwise(F.concat(F.lit("<priority>0."), key % 10, F.lit("</priority>"))), F.lit("</url>"),
    )
    listed = table(spark, sf_dir, "customer").groupBy(F.expr(f"c_custkey div {PACK}").alias("file")).agg(F.array_join(F.collect_list(entry), "").alias("x"))
    whole = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>"))
    return readers.sitemaps(spark, _written(listed.select("file", whole.alias("value")), "xml")).select("kind", "loc", "lastmod", "priority")


@_r.query("s17_event_file", "select event_type, epoch(ts) as timestamp, user_id::varchar as session_id, value::varchar as value from events where event_type in ('click', 'view')")
def s17_event_file(spark, sf_dir):
    """Events of known kinds of a capture file, bad lines passed over."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.col("user_id").cast("string").alias("session_id"), F.col("value").cast("string").alias("value"))
    lines = rows.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("no json",), ('{"event_type": "click"}',)], "value string"))
    return readers.event_log(spark, _written(lines, "jsonl"), ("click", "view")).drop("selector")


@_r.query("k1_export_jsonl", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'F'")
def k1_export_jsonl(spark, sf_dir):
    """Orders exported as JSON lines and as Parquet, the shares read back together."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    lines, columns = _folder(spark, "out"), _folder(spark, "out")
    sinks.export(rows.where("o_orderstatus = 'O'"), lines, "jsonl")
    sinks.export(rows.where("o_orderstatus = 'P'"), columns, "parquet")
    return readers.json_lines(spark, lines).select(rows.columns).union(spark.read.parquet(columns))


@_r.query("f27_personal_context", """
with p as (select doc_id, text, strpos(text, 'the') as spot from documents where strpos(text, 'the') > 0),
n as (select doc_id, substr(text, greatest(1, spot - 120)::bigint, (3 + 240)::bigint) as near from p)
select doc_id, """ + " or ".join(f"regexp_matches(near, '{p}')" for p in redaction.CONTEXT) + " as personal from n")
def f27_personal_context(spark, sf_dir):
    """Whether signs of a person stand near the first `the` of each document."""
    at = F.instr("text", "the")
    rows = table(spark, sf_dir, "documents").where(at > 0)
    return rows.select("doc_id", redaction.personal_context(F.col("text"), at - 1, at + 2).alias("personal"))


@_r.query("f49_erasure_deadlines", """
select o_orderkey, o_orderdate + interval 30 day as due, o_orderstatus <> 'F' and o_orderdate + interval 30 day < timestamp '1998-01-01' as overdue,
  case when o_orderstatus <> 'F' then date_diff('day', date '1998-01-01', (o_orderdate + interval 30 day)::date) end::int as days_left from orders""")
def f49_erasure_deadlines(spark, sf_dir):
    """Orders as requests of erasure: when each is due, and how late it is."""
    rows = table(spark, sf_dir, "orders").withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    found = governance.deadlines(rows, F.lit("1998-01-01").cast("timestamp"), "o_orderdate", "done")
    return found.select("o_orderkey", F.col("due").cast("timestamp_ntz").alias("due"), "overdue", "days_left")


# streams


def _stream(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@_r.query("r1_replayed", "select event_id, user_id, event_type from events")
def r1_replayed(spark, sf_dir):
    """Events written as several files and replayed a file a batch."""
    path = _folder(spark, "replay")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    rows.repartition(4, "event_id").write.parquet(path)
    stream = streams.replayed(spark, path, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    return streams.stored(stream, _folder(spark, "replayed"), _folder(spark, "stream")).select("event_id", "user_id", "event_type")


@_r.query("c22_counters", "select event_type, count(*) as n from events group by event_type")
def c22_counters(spark, sf_dir):
    """Running counts by kind of event."""
    return streams.stored(streams.counters(_stream(spark, sf_dir), "event_type"), _folder(spark, "counters"), _folder(spark, "stream"), "complete")


@_r.query("r8_sink_with_dead_letters", "select event_id, user_id, cast(null as varchar) as error from events where event_type <> 'error' union all select event_id, user_id, 'ValueError: errors are refused' from events where event_type = 'error'")
def r8_sink_with_dead_letters(spark, sf_dir):
    """Two streams to a sink that refuses errors: what it takes, and the batches kept with the reason."""
    good, dead = _folder(spark, "sink"), _folder(spark, "dead")

    def write(batch, epoch):
        if not batch.where("event_type = 'error'").isEmpty():
            raise ValueError("errors are refused")
        batch.write.mode("overwrite").parquet(f"{good}/epoch={epoch}")

    rows = _stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    for part in (rows.where("event_type <> 'error'"), rows.where("event_type = 'error'")):
        query = part.writeStream.foreachBatch(streams.with_dead_letters(write, dead)).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
    taken = spark.read.parquet(good).withColumn("error", F.lit(None).cast("string"))
    return taken.select("event_id", "user_id", "error").union(spark.read.parquet(dead).select("event_id", "user_id", "error"))


@_r.query("r9_sealed_once", "select user_id, count(*)::int as n from events group by user_id")
def r9_sealed_once(spark, sf_dir):
    """A sink of sealed batches that runs a batch twice keeps it once."""
    path = _folder(spark, "seals")
    sink = streams.sealed(path, "user_id", "event_id", "h")

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)

    rows = _stream(spark, sf_dir).withColumn("h", F.sha2(F.col("event_id").cast("string"), 256))
    query = rows.writeStream.foreachBatch(twice).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).select("user_id", F.col("n").cast("int").alias("n"))
