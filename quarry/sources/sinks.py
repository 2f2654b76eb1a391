"""Sinks and exporters. Large results are written by Spark; single small files by the driver."""

from __future__ import annotations

import hashlib
import hmac
import json
import sqlite3
import urllib.request
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Entries that an evidence package has to have: fixed values.
EVIDENCE = ("manifest.json", "chain.jsonl", "receipt.json", "rights.json", "artifacts.json")


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, nulls as empty text, other values as they are."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, ArrayType | MapType | StructType)
        c = F.to_json(c) if nested else c
        out.append((F.coalesce(c, F.lit("")) if nested or f.dataType.simpleString() == "string" else c).alias(f.name))
    return rows.select(*out)


def _some(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("nothing to export")
    return rows


def export(rows: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """Writes rows as jsonl, json, csv or parquet; an empty result raises."""
    writer = {"parquet": lambda: _some(rows).write, "csv": lambda: _some(flat(rows).select([F.col(f"`{c}`").cast("string") for c in rows.columns])).write.option("header", True)}
    if kind in writer:
        writer[kind]().mode(mode).format(kind).save(path)
    elif kind in ("jsonl", "json"):
        _some(rows).write.mode(mode).option("ignoreNullFields", kind == "jsonl").json(path)
    else:
        raise ValueError(f"no format {kind}")


def arrow_stream(rows: DataFrame, path: str, columns: list[str] | None = None, batch: int = 1000) -> int:
    """An Arrow IPC file of some columns, in batches of so many rows; returns the rows."""
    table = (rows.select(*columns) if columns else rows).toArrow()
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        for part in table.to_batches(max_chunksize=batch):
            writer.write_batch(part)
    return table.num_rows


def sqlite(rows: DataFrame, path: str, name: str, search: list[str] | None = None) -> int:
    """A SQLite table of rows, with a full-text index of some columns; rows reach the driver one by one."""
    held, n = flat(rows), 0
    names = ", ".join(f'"{c}"' for c in held.columns)
    with sqlite3.connect(path) as db:
        db.execute(f'create table if not exists "{name}" ({names})')
        for r in held.toLocalIterator():
            db.execute(f'insert into "{name}" values ({", ".join("?" * len(held.columns))})', [str(v) if not isinstance(v, int | float | str | type(None)) else v for v in r])
            n += 1
        if search:
            listed = ", ".join(f'"{c}"' for c in search)
            db.execute(f'create virtual table if not exists "{name}_fts" using fts5({listed})')
            db.execute(f'insert into "{name}_fts" select {listed} from "{name}"')
    db.close()
    return n


def dataset_card(rows: DataFrame, name: str) -> str:
    fields = "\n".join(f"- {f.name}: {f.dataType.simpleString()}" for f in rows.schema.fields)
    return f"---\npretty_name: {name}\n---\n\n# {name}\n\n{rows.count()} rows.\n\n{fields}\n"


def markdown_row(columns: Iterable[str], width: int = 80) -> Column:
    """A row of a markdown table: pipes escaped, cells cut, nulls empty."""
    cell = lambda c: F.substring(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), 1, width)
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def html_row(columns: Iterable[str], width: int = 200) -> Column:
    def cell(c: str) -> Column:
        out = F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, width)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return F.concat(F.lit("<td>"), out, F.lit("</td>"))

    return F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))


def wire(rows: DataFrame, kind: str) -> DataFrame:
    """(line) of each row as ndjson, as a server-sent event or as a websocket message."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    line = {"ndjson": body, "sse": F.concat(F.lit("data: "), body, F.lit("\n\n")), "websocket": F.to_json(F.struct(F.lit("pack").alias("type"), F.struct(*rows.columns).alias("data")))}[kind]
    return rows.select(line.alias("line"))


def handoff(packs: DataFrame, subscriptions: DataFrame, status: str, kind: str) -> DataFrame:
    """(pack columns, agents): promoted packs with the sorted agents subscribed to their kind.

    A list is made once for each kind and broadcast, so all lists together (an agent and kind each once) have to fit a task;
    packs are dealt to all cores, for those of one kind are given the same long list."""
    wants = subscriptions.select("agent", F.explode("pack_types").alias(kind))
    agents = wants.groupBy(kind).agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    dealt = packs.where(F.col(status) == "promoted").repartition(4 * packs.sparkSession.sparkContext.defaultParallelism)
    return dealt.join(F.broadcast(agents), kind, "left").withColumn("agents", F.coalesce("agents", F.array().cast("array<string>")))


def put(new: DataFrame, store: DataFrame, content: str, order: str) -> DataFrame:
    """What a content-addressed store takes in of new rows: the first of each hash that it lacks, with its
    path."""
    marked = new.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    first = marked.groupBy("sha256").agg(F.min(order).alias(order))
    fresh = marked.join(first, ["sha256", order], "left_semi").dropDuplicates(["sha256"]).join(store.select("sha256"), "sha256", "left_anti")
    return fresh.withColumn("path", F.concat(F.lit("objects/"), F.substring("sha256", 1, 2), F.lit("/"), F.col("sha256")))


def cached(rows: DataFrame, cache: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """rows with a value by the hash of their text: from the cache, else computed once for each text."""
    marked = rows.withColumn("sha256", F.sha2(text, 256))
    missing = marked.select("sha256", text).dropDuplicates(["sha256"]).join(cache.select("sha256"), "sha256", "left_anti")
    known = cache.select("sha256", value).unionByName(compute(missing).select("sha256", value))
    return marked.join(known, "sha256", "left")


def evidence_package(entries: dict[str, bytes], path: str) -> None:
    """A ZIP of entries in order of name; raises if one of the required ones is missing."""
    if lost := [n for n in EVIDENCE if n not in entries]:
        raise ValueError(f"missing {lost}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name in sorted(entries):
            out.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), entries[name])


def signature(body: bytes, secret: bytes) -> str:
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def webhook(url: str, secret: bytes, send: Callable[[str, bytes, dict[str, str]], int] | None = None, tries: int = 3) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each row is posted with its signature; rows that fail are returned by raising
    after the last try. send(url, body, headers) gives a status; by default it posts."""

    def post(to: str, body: bytes, headers: dict[str, str]) -> int:
        with urllib.request.urlopen(urllib.request.Request(to, body, headers), timeout=10) as answer:
            return answer.status

    def run(batch: DataFrame, epoch: int) -> None:
        for r in batch.toJSON().toLocalIterator():
            body = json.dumps(json.loads(r), sort_keys=True).encode()
            headers = {"Content-Type": "application/json", "X-Signature-256": signature(body, secret)}
            if not any((send or post)(url, body, headers) < 300 for _ in range(tries)):
                raise RuntimeError(f"batch {epoch}: {url} took no message in {tries} tries")

    return run


def database(rows: DataFrame, path: str, name: str, kinds: dict[str, str]) -> tuple[str, dict[str, str]]:
    """Loads rows into a table of a new database under a shared folder, which driver and executors mount alike: its JDBC
    URL and options. kinds are the SQL types of text columns.

    A Derby database that can be written is held by one process. So tasks write rows as CSV files, which
    the database in the driver's JVM imports by itself, a file at a time; then it is shut down and put, uncompressed, into
    an archive, which any number of processes read at once."""
    jvm, local = rows.sparkSession.sparkContext._jvm, urlparse(path).path
    url, options = f"jdbc:derby:{local}/db", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    connect = lambda more="": jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(url + more, jvm.java.util.Properties())
    rows.write.option("escape", '"').csv(f"{path}/rows")
    typed = rows.limit(0).write.option("createTableColumnTypes", ", ".join(f"{c} {k}" for c, k in kinds.items()))
    typed.jdbc(f"{url};create=true", name, properties=options)
    held = connect()
    for part in sorted(Path(f"{local}/rows").glob("part-*")):
        call = held.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
        call.setString(1, name.upper())
        call.setString(2, str(part))
        call.execute()
        call.close()
    held.close()
    try:
        connect(";shutdown=true")
    except Py4JJavaError as told:
        if told.java_exception.getSQLState() != "08006":  # how Derby says that it is shut down
            raise
    with zipfile.ZipFile(f"{local}/db.jar", "w", zipfile.ZIP_STORED) as out:
        for part in sorted(Path(f"{local}/db").rglob("*")):
            out.write(part, part.relative_to(local))
    return f"jdbc:derby:jar:({local}/db.jar)db", options
