"""Records of unknown shape as variants: traces, HTTP archives, and pages of vendors' interfaces mapped to records.

Texts are parsed once to VARIANT; arrays are exploded by Spark's own table function and fields taken by
path, so nothing of it runs in Python. What is no JSON gives no rows; a field that is missing, or of another kind, is null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpointed


def texts(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(file, text) of the files of a folder: each line a JSON text, or each file."""
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=not lines)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parsed(rows: DataFrame, column: str, out: str = "v") -> DataFrame:
    """rows with a text's JSON as a variant; null where it is none."""
    return rows.withColumn(out, F.try_parse_json(column))


def items(rows: DataFrame, v: str, path: str, *keep: str) -> DataFrame:
    """(keep, position, item): the elements of the array at a path, "$" for the variant itself."""
    held = rows.select(*keep, F.try_variant_get(F.col(v), path, "variant").alias("_at")).where(F.schema_of_variant("_at").startswith("ARRAY<"))
    out = held.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_at").outer()))
    return out.select(*keep, F.col("pos").alias("position"), F.col("value").alias("item"))


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def leaves(rows: DataFrame, v: str, *keep: str) -> DataFrame:
    """(keep, path, value): each value of a variant that is no object or array, as text, by its path (a.b[0]);
    null gives an empty text. Objects and arrays are opened level by level until none is left, whatever their
    depth; empty ones give no row."""
    open_ = rows.select(*keep, F.lit("").alias("path"), F.col(v).alias("_v")).where(F.col(v).isNotNull())
    done = None
    while True:
        kind = F.schema_of_variant("_v")
        told = checkpointed(open_.withColumn("_nested", kind.startswith("OBJECT<") | kind.startswith("ARRAY<")))
        flat = told.where("not _nested").select(*keep, "path", F.coalesce(F.try_variant_get(F.col("_v"), "$", "string"), F.lit("")).alias("value"))
        done = flat if done is None else done.unionByName(flat)
        inner = told.where("_nested")
        if inner.isEmpty():
            return done
        each = inner.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        open_ = each.select(*keep, name.alias("path"), F.col("value").alias("_v"))


def trace_actions(traces: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep, start_url, position, action_type, target_selector, value, metadata) of recorded browser sessions, a JSON
    text each: {"start_url", "actions": [{"type", "selector", "value", ...}]}. metadata is the whole action."""
    v = parsed(traces, text, "_v").withColumn("start_url", F.coalesce(get(F.col("_v"), "$.start_url"), F.lit("unknown")))
    x = F.col("item")
    return items(v, "_v", "$.actions", *keep, "start_url").select(
        *keep, "start_url", "position", F.coalesce(get(x, "$.type"), F.lit("unknown")).alias("action_type"), get(x, "$.selector").alias("target_selector"),
        get(x, "$.value").alias("value"), x.alias("metadata"),
    )


def har_entries(archives: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep, position, started, method, url, status, mime, bytes, milliseconds) of HTTP archives (log.entries)."""
    x = F.col("item")
    return items(parsed(archives, text, "_v"), "_v", "$.log.entries", *keep).select(
        *keep, "position", get(x, "$.startedDateTime", "timestamp").alias("started"), get(x, "$.request.method").alias("method"), get(x, "$.request.url").alias("url"),
        get(x, "$.response.status", "int").alias("status"), get(x, "$.response.content.mimeType").alias("mime"), get(x, "$.response.content.size", "long").alias("bytes"),
        get(x, "$.time", "double").alias("milliseconds"),
    )


@dataclass(frozen=True)
class Mapping:
    """Where a vendor's pages hold their records and a record's fields; next is the path of the next page's
    cursor. content may be a document of nested blocks (rich)."""

    items: str
    record_id: str
    title: str
    content: str
    source_url: str
    next: str | None = None
    rich: bool = False
    metadata: dict[str, str] = field(default_factory=dict)


#: Fields of the vendors' public interfaces.
MAPPINGS = {
    "jira": Mapping("$.issues", "$.key", "$.fields.summary", "$.fields.description", "$.self", rich=True, metadata={"status": "$.fields.status.name", "assignee": "$.fields.assignee.displayName"}),
    "confluence": Mapping("$.results", "$.id", "$.title", "$.body.storage.value", "$._links.webui", "$._links.next", metadata={"space": "$.space.key"}),
    "github_issues": Mapping("$", "$.number", "$.title", "$.body", "$.html_url", metadata={"state": "$.state", "author": "$.user.login"}),
    "github_tree": Mapping("$.tree", "$.sha", "$.path", "$.content", "$.url", metadata={"type": "$.type", "size": "$.size"}),
    "gitlab_issues": Mapping("$", "$.iid", "$.title", "$.description", "$.web_url", metadata={"state": "$.state", "author": "$.author.username"}),
    "slack": Mapping("$.messages", "$.ts", "$.user", "$.text", "$.permalink", "$.response_metadata.next_cursor", metadata={"thread": "$.thread_ts"}),
    "notion": Mapping("$.results", "$.id", "$.properties.title.title[0].plain_text", "$.properties.body.rich_text[0].plain_text", "$.url", "$.next_cursor"),
    "airtable": Mapping("$.records", "$.id", "$.fields.Name", "$.fields.Notes", "$.url", "$.offset"),
}

_BLOCKS = "array<struct<content:array<struct<type:string,text:string>>>>"


def vendor_records(pages: DataFrame, vendor: str, text: str = "text") -> DataFrame:
    """(record_id, title, content, source_url, source_type, metadata) of a vendor's pages, a JSON text each. Records
    without an id are left out; metadata has the fields that a record has."""
    m, x = MAPPINGS[vendor], F.col("item")
    content = get(x, m.content)
    if m.rich:
        blocks = F.flatten(F.transform(get(x, f"{m.content}.content", _BLOCKS), lambda b: F.coalesce(b["content"], F.array().cast("array<struct<type:string,text:string>>"))))
        content = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda t: t["type"] == "text"), lambda t: t["text"]), " "), content)
    pairs = [F.struct(F.lit(k).alias("key"), get(x, p).alias("value")) for k, p in m.metadata.items()]
    metadata = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    return items(parsed(pages, text, "_v"), "_v", m.items).select(
        get(x, m.record_id).alias("record_id"), get(x, m.title).alias("title"), F.coalesce(content, F.lit("")).alias("content"), get(x, m.source_url).alias("source_url"),
        F.lit(vendor).alias("source_type"), metadata.alias("metadata"),
    ).where("record_id is not null")


def next_cursor(v: Column, vendor: str) -> Column:
    """The cursor of the page behind a page, null on the last. Jira counts instead: startAt and the issues on the page,
    until total."""
    m = MAPPINGS[vendor]
    if vendor == "jira":
        behind = get(v, "$.startAt", "long") + F.size(get(v, "$.issues", "array<variant>"))
        return F.when(behind < get(v, "$.total", "long"), behind.cast("string"))
    found = get(v, m.next) if m.next else F.lit(None).cast("string")
    return F.when(found != "", found)
