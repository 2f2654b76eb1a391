"""Rights, retention, erasure, promotion gates, versions and pack quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default rights by class of source: (training, redistribution, retention, review). Fixed values.
RIGHTS = {
    "owned_internal": ("allowed", "restricted", "long", "owner_asserted"),
    "customer_confidential": ("forbidden", "forbidden", "policy_bound", "pending"),
    "licensed_reference": ("unknown", "restricted", "long", "pending"),
    "public_web": ("reference_only", "restricted", "medium", "pending"),
    "personal_device_memory": ("forbidden", "forbidden", "short", "pending"),
    "synthetic_eval": ("allowed", "allowed", "long", "approved"),
    "oss_code_or_docs": ("unknown", "unknown", "long", "pending"),
}
#: Hours that each retention class keeps; a legal hold never ends. Fixed values.
RETENTION_HOURS = {"short": 24, "medium": 90 * 24, "long": 1095 * 24, "policy_bound": 365 * 24}
REVIEWED = ("approved", "owner_asserted_and_reviewed")
#: Allowed changes of state: fixed values.
PACK_STATES = {"pending": ("approved", "rejected", "deferred"), "deferred": ("approved", "rejected", "deleted"), "approved": ("deleted",), "rejected": ("deleted",), "deleted": ()}
RUN_STATES = {"pending": ("running", "cancelled"), "running": ("paused", "completed", "failed", "cancelled"), "paused": ("running", "cancelled"), "completed": (), "failed": (), "cancelled": ()}
ALIASES = {"candidate": "pending", "promoted": "approved"}


def with_default_rights(rows: DataFrame, source_class: str) -> DataFrame:
    """rows with the default rights of their class of source; unknown classes get nulls."""
    names = ("training_eligibility", "redistribution_eligibility", "retention_class", "review_status")
    known = rows.sparkSession.createDataFrame([(k, *v) for k, v in RIGHTS.items()], ["_class", *names])
    return rows.join(F.broadcast(known), F.col(source_class) == F.col("_class"), "left").drop("_class")


def promotion_eligible(legal_hold: Column, requires_redaction: Column, review: Column, training: Column) -> Column:
    return ~legal_hold & ~requires_redaction & review.isin(*REVIEWED) & (training != "forbidden")


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.9, "green").when(score >= 0.75, "yellow").when(score >= 0.5, "orange").otherwise("red")


def confidence_label(score: Column) -> Column:
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(held >= 0.8, "HIGH").when(held >= 0.5, "MEDIUM").otherwise("LOW")


def gates(provenance: Column, rights: Column, replay: Column, deterministic: Column, redacted: Column, signed: Column, least_replay: float = 0.85) -> Column:
    """The six gates of promotion as an array of the names of those that fail, in their order; null inputs
    fail."""
    checks = {
        "provenance": provenance >= 1.0, "rights_status": F.lower(rights).isin(*REVIEWED), "replay_pass_rate": replay >= least_replay,
        "deterministic": deterministic, "redaction_complete": redacted, "human_signoff": signed,
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def write_violations(source_url: Column, license_: Column, local_only: Column, destination: Column, run_id: Column, signal: Column) -> Column:
    """What of a write breaks the contract of a run, as an array of names in their order."""
    empty = lambda c: c.isNull() | (F.trim(c) == "")
    remote = F.coalesce(destination, F.lit("")).rlike(r"^(https?|s3a?|gs|ftp|wss?)://")
    checks = {
        "source_url": empty(source_url), "license": empty(license_), "local_only": F.coalesce(local_only, F.lit(False)) & remote,
        "run_id": empty(run_id), "signal": empty(signal) | ~F.coalesce(signal, F.lit("")).rlike(r"^[a-z0-9_]+\.[a-z0-9_]+$"),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def expires_at(registered: Column, retention: Column) -> Column:
    """When a record's retention ends; null for a legal hold and for unknown classes."""
    out = F.lit(None).cast("timestamp")
    for name, hours in RETENTION_HOURS.items():
        out = F.when(retention == name, registered + F.expr(f"interval {hours} hours")).otherwise(out)
    return out


def collected(records: DataFrame, as_of: Column, registered: str, retention: str) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) at a time; a record expires at its end."""
    marked = records.withColumn("expires_at", expires_at(F.col(registered).cast("timestamp"), F.col(retention)))
    over = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    return marked.where(~over), marked.where(over)


def erasure(requests: DataFrame, registry: DataFrame, key: str, retention: str) -> DataFrame:
    """(request_id, outcome, n, ids): artifacts that requests name as erased, legal_hold or not_found."""
    joined = requests.join(registry.select(key, retention), key, "left")
    outcome = F.when(F.col(retention).isNull(), "not_found").when(F.col(retention) == "legal_hold", "legal_hold").otherwise("erased")
    return joined.groupBy("request_id", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ids"))


def compliance(requests: DataFrame, as_of: Column, received: str, fulfilled: str, days: int = 30) -> DataFrame:
    """One row: total, fulfilled, overdue and the share fulfilled (1 of nothing)."""
    due = F.col(received).cast("timestamp") + F.expr(f"interval {days} days")
    done = F.col(fulfilled).isNotNull()
    out = requests.agg(F.count("*").alias("total"), F.count_if(done).alias("fulfilled"), F.count_if(~done & (due < as_of)).alias("overdue"))
    return out.withColumn("fulfilment_rate", F.round(F.when(F.col("total") > 0, F.col("fulfilled") / F.col("total")).otherwise(1.0), 4))


def deadlines(requests: DataFrame, as_of: Column, received: str, fulfilled: str, days: int = 30) -> DataFrame:
    """requests with due (so many days after they came), overdue (not fulfilled, and due before as_of) and
    days_left (by date, negative when late; null once fulfilled)."""
    due, open_ = F.col(received).cast("timestamp") + F.expr(f"interval {days} days"), F.col(fulfilled).isNull()
    return requests.withColumns({"due": due, "overdue": open_ & (due < as_of), "days_left": F.when(open_, F.date_diff(F.to_date(due), F.to_date(as_of)))})


def unregistered(packs: DataFrame, registry: DataFrame, pack: str, artifact: str) -> DataFrame:
    """(pack, missing): artifacts of packs that the registry does not know."""
    lost = packs.join(registry.select(artifact).distinct(), artifact, "left_anti")
    return lost.groupBy(pack).agg(F.array_sort(F.collect_set(artifact)).alias("missing"))


def pack_quality(packs: DataFrame, fields: list[str], as_of: float, artifacts: str = "artifacts") -> DataFrame:
    """packs with completeness (share of fields present), diversity (kinds of artifacts by five), freshness
    (linear over a year; 0.5 without times, 0 without artifacts) and overall (0.4, 0.3, 0.3)."""
    present = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    kinds = F.size(F.array_distinct(F.transform(artifacts, lambda a: F.coalesce(a["content_type"], F.lit("unknown")))))
    times = F.filter(F.transform(artifacts, lambda a: a["created_at"]), lambda t: t > 0)
    mean = F.aggregate(times, F.lit(0.0), lambda a, t: a + t) / F.greatest(F.size(times), F.lit(1))
    some = F.coalesce(F.size(F.col(artifacts)), F.lit(0)) > 0
    fresh = F.when(~some, 0.0).when(F.size(times) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - (as_of - mean) / 86400 / 365))
    scored = packs.withColumns({"completeness": present / len(fields), "diversity": F.when(some, F.least(F.lit(1.0), kinds / 5)).otherwise(0.0), "freshness": fresh})
    return scored.withColumn("overall", F.col("completeness") * 0.4 + F.col("diversity") * 0.3 + F.col("freshness") * 0.3)


def semver(version: Column) -> Column:
    """(major, minor, patch) of a version x.y.z; null if it is none."""
    part = lambda g: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", g).try_cast("int")
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def bump_kind(old: Column, new: Column) -> Column:
    """major, minor, patch or none: the first part that is greater; unknown if a version is none."""
    a, b = semver(old), semver(new)
    return F.when(a.isNull() | b.isNull(), "unknown").when(b["major"] > a["major"], "major").when(b["minor"] > a["minor"], "minor").when(b["patch"] > a["patch"], "patch").otherwise("none")


def bumped(version: Column, kind: str) -> Column:
    v = semver(version)
    made = {"major": (v["major"] + 1, F.lit(0), F.lit(0)), "minor": (v["major"], v["minor"] + 1, F.lit(0)), "patch": (v["major"], v["minor"], v["patch"] + 1)}[kind]
    return F.when(v.isNotNull(), F.concat_ws(".", *[x.cast("string") for x in made]))


def migration_errors(old_rank: Column, new_rank: Column, removed: Column, bump: Column) -> Column:
    """Errors of a migration: rights that loosen, and removals without a major version."""
    return F.array_compact(F.array(F.when(new_rank < old_rank, F.lit("rights loosened")), F.when((removed > 0) & (bump != "major"), F.lit("removal without major version"))))


def full_diff(old: DataFrame, new: DataFrame, key: list[str], position: str, value: Column) -> DataFrame:
    """(key, change, old_value, new_value, position): added, removed, modified and unchanged rows; rows of the
    old side come first in their order, then added ones in theirs."""
    a = old.select(*key, F.col(position).alias("_p"), value.alias("_v"), F.lit(True).alias("_in"))
    b = new.select(*key, F.col(position).alias("_q"), value.alias("_w"), F.lit(True).alias("_there"))
    change = F.when(F.col("_in").isNull(), "added").when(F.col("_there").isNull(), "removed").when(F.col("_v").eqNullSafe(F.col("_w")), "unchanged").otherwise("modified")
    order = F.struct(F.when(F.col("_in"), 0).otherwise(1).alias("side"), F.coalesce("_p", "_q").alias("at"))
    return a.join(b, key, "full_outer").select(*key, change.alias("change"), F.col("_v").alias("old_value"), F.col("_w").alias("new_value"), order.alias("position"))


def list_difference(left: Column, right: Column) -> Column:
    """Elements of the left array that the right one lacks, in order, repeated ones too."""
    return F.filter(left, lambda x: ~F.array_contains(right, x))


def overridden(base: Column, patch: Column) -> Column:
    """A map with another's entries put over its own."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)


def normalised_state(state: Column) -> Column:
    out = F.lower(state)
    for alias, name in ALIASES.items():
        out = F.when(out == alias, F.lit(name)).otherwise(out)
    return out


def sync_state(local: DataFrame, remote: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, state): pending (here only), conflict (different there), synced, or remote_only."""
    there = remote.select(key, F.col(mark).alias("_r"))
    state = F.when(F.col("_r").isNull(), "pending").when(F.col(mark).isNull(), "remote_only").when(F.col(mark) == F.col("_r"), "synced").otherwise("conflict")
    return local.select(key, mark).join(there, key, "full_outer").select(key, state.alias("state"))


LICENSES = r"(?i)\b(affero|agpl)\b"


def license_findings(docs: DataFrame, id_col: str, text_col: str, pattern: str = LICENSES) -> DataFrame:
    """(id, line_number, line, quarantined) of lines that speak of a licence; those of the pattern are set
    apart."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_number", "line"))
    return rows.where(F.col("line").rlike(r"(?i)licen[cs]e|copyright|agpl")).withColumn("quarantined", F.col("line").rlike(pattern))


def requirement(line: Column) -> Column:
    """(package, version) of a line of requirements: the name normalised as indexes do, the pinned version."""
    name = F.regexp_extract(line, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.struct(F.lower(F.regexp_replace(name, r"[-_.]+", "-")).alias("package"), F.nullif(F.regexp_extract(line, r"==\s*([^\s;,]+)", 1), F.lit("")).alias("version"))


def template(text: str, values: dict[str, Column]) -> Column:
    """A text with {{name}} replaced by columns; unknown names become empty."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{\{\s*\w+\s*\}\}", "")


def states_table(spark: SparkSession, states: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, x in states.items() for b in x], "before string, after string")


def illegal_transitions(moves: DataFrame, states: dict[str, tuple[str, ...]]) -> DataFrame:
    """Moves (before, after) that a state machine does not allow."""
    return moves.join(F.broadcast(states_table(moves.sparkSession, states)), ["before", "after"], "left_anti")


def rolled_back(history: DataFrame, key: str, order: str, version: str) -> DataFrame:
    """(key, version) before the last one of each key that has one."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return history.withColumn("_n", F.row_number().over(by)).where("_n = 2").select(key, version)
