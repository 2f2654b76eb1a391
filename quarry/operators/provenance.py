"""Hash chains, Merkle roots, canonical JSON and manifests."""

from __future__ import annotations

import hashlib
import hmac
import json
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.operators.sessions import folded
from quarry.session import checkpointed

GENESIS = "genesis"
#: Signals that a complete run has to show: fixed values.
REQUIRED = ("acquire.completed", "normalize.completed", "chunk.completed", "pack.completed", "eval.completed")


def canonical_json(text: str | None, spaced: bool = True, ascii_only: bool = True) -> str | None:
    """JSON text with sorted keys; spaced has ", " and ": " between, else nothing."""
    return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=ascii_only, separators=None if spaced else (",", ":"))


def with_canonical(rows: DataFrame, column: str, out: str, spaced: bool = True, ascii_only: bool = True) -> DataFrame:
    @F.pandas_udf("string")
    def made(values: pd.Series) -> pd.Series:
        return values.map(lambda v: canonical_json(v, spaced, ascii_only))

    return rows.withColumn(out, made(column))


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def chained(rows: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """(key, order, payload, prev_hash, entry_hash): each entry's hash covers the one before of its key. A fold
    over a key's payloads, which stream through; from a null payload on, hashes are null."""

    def step(held: str | None, own: str | None) -> tuple[str | None, str | None]:
        return None if held is None or own is None else hashlib.sha256((held + own).encode()).hexdigest(), held

    out = folded(rows.select(key, *order, payload.alias("payload")), key, order, ["payload"], GENESIS, step, "prev_hash", StringType())
    return out.withColumn("entry_hash", entry_hash(F.col("prev_hash"), F.col("payload")))


def broken_links(rows: DataFrame, key: str, order: list[str], payload: Column, stored: str) -> DataFrame:
    """Rows whose stored hash does not follow from the hash stored before it; rows without one are passed
    over, as entries of before hashing."""
    by = Window.partitionBy(key).orderBy(*order)
    held = rows.where(F.col(stored).isNotNull()).withColumn("_prev", F.lag(stored, 1, GENESIS).over(by))
    return held.withColumn("expected", entry_hash(F.col("_prev"), payload)).where(F.col("expected") != F.col(stored)).drop("_prev")


def first_failure(rows: DataFrame, key: str, sequence: str, payload: Column, stored: str) -> DataFrame:
    """(key, sequence, reason) of each key's first entry whose number or content hash is wrong."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(sequence))
    reason = F.when(place != F.col(sequence), F.lit("sequence gap")).when(F.sha2(payload, 256) != F.col(stored), F.lit("content hash"))
    bad = rows.withColumn("reason", reason).where("reason is not null")
    return bad.groupBy(key).agg(F.min(sequence).alias(sequence), F.min_by("reason", sequence).alias("reason"))


def merkle_roots(rows: DataFrame, key: str, order: list[str], content_hash: str) -> DataFrame:
    """(key, n, root): leaves are hashes of content hashes, in order; an odd level repeats its last; levels
    are halved by one aggregate each, so a long chain is spread over tasks."""
    # places come from a window by key; each level then groups by (key, pair)
    by = Window.partitionBy(key).orderBy(*order)
    level = rows.select(key, (F.row_number().over(by) - 1).alias("pos"), F.sha2(F.col(content_hash), 256).alias("h"))
    sizes = level.groupBy(key).agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    rounds = max(0, (longest - 1).bit_length())
    for i in range(rounds):
        level = level.groupBy(key, F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("h", "pos").alias("l"), F.max_by("h", "pos").alias("r"), F.count("*").alias("c"), F.max("pos").alias("last"))
        alone = Window.partitionBy(key)
        level = level.withColumn("_only", F.max("last").over(alone) == 0)
        level = level.select(key, "pos", F.when(F.col("_only"), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("h"))
        level = checkpointed(level) if i % 8 == 7 else level
    return level.select(key, F.col("h").alias("root")).join(sizes, key).select(key, "n", "root")


def merkle_root(hashes: list[str]) -> str:
    """The same of a list of content hashes; that of an empty one is the hash of nothing."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [digest(h) for h in hashes]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [digest(a + b) for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0] if level else digest("")


def signed(manifest: str, secret: bytes) -> str:
    return hmac.new(secret, manifest.encode(), hashlib.sha256).hexdigest()


def provenance_score(signals: DataFrame, key: str, signal: str) -> DataFrame:
    """(key, provenance_score): the share of required signals that a run shows."""
    return signals.groupBy(key).agg((F.count_distinct(F.when(F.col(signal).isin(*REQUIRED), F.col(signal))) / len(REQUIRED)).alias("provenance_score"))


def last_value(rows: DataFrame, key: str, order: str, signal: str, wanted: str, value: str) -> DataFrame:
    """(key, value): the last non-empty value that a run's entries of one signal carry."""
    kept = rows.where((F.col(signal) == wanted) & F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return kept.groupBy(key).agg(F.max_by(value, order).alias(value))


def manifest(artifacts: DataFrame, name: str, content: str, category: str) -> DataFrame:
    """One row: total files and bytes, sorted categories, and the hash of all entries in order of name."""
    rows = artifacts.select(name, category, F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))
    per = rows.groupBy(F.substring(F.sha2(F.col(name).cast("string"), 256), 1, 4).alias("bucket")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, "sha256"))), lambda x: F.concat_ws(":", x[name].cast("string"), x["sha256"])), "\n"), 256).alias("h"), F.sum("size").alias("size"), F.count("*").alias("n"), F.collect_set(category).alias("cats"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), "\n"), 256)
    return per.agg(F.sum("n").alias("total_files"), F.sum("size").alias("total_bytes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cats")))).alias("categories"), whole.alias("manifest_hash"))


def signal_parts(signal: Column) -> Column:
    """(plane, action, terminal) of plane.action; null where there is no dot."""
    action = F.substring(signal, F.instr(signal, ".") + 1, F.length(signal))
    return F.when(F.instr(signal, ".") > 0, F.struct(F.substring_index(signal, ".", 1).alias("plane"), action.alias("action"), action.rlike("(^|[._])(completed|failed)$").alias("terminal")))


def decision_log(rows: DataFrame, keys: list[str], order: str, payload: Column) -> DataFrame:
    """rows with parent (the node given, else the latest before of the same keys) and prev_hash's payload."""
    by = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("parent", F.coalesce("parent_id", F.lag(order).over(by))).withColumn("payload_hash", F.sha2(payload, 256))


def sealed_batches(rows: DataFrame, key: str, order: str, content_hash: str, every: int) -> DataFrame:
    """(key, seal, n, root): a Merkle root for each run of so many entries."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    marked = rows.withColumn("_seal", F.floor(place / every)).withColumn("_k", F.struct(key, F.col("_seal").alias("seal")))
    return merkle_roots(marked, "_k", [order], content_hash).select(f"_k.{key}", "_k.seal", "n", "root")
