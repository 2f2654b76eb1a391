"""Packs: procedures, steps, cases, receipts and recorded interactions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import governance, provenance

#: Largest scroll and pause that runs of scrolls may have: fixed values.
SCROLL_PX, SCROLL_SECONDS = 50.0, 0.5


def merged_scrolls(events: DataFrame, key: str, order: str, seconds: str, kind: str, delta: str) -> DataFrame:
    """(key, step, kind, delta, first, last, n): runs of scrolls of one direction as one step, other events
    alone. A scroll joins the run before if it is at most 50 px, comes within half a second and does not
    turn the run's summed direction. A fold, for the sum decides; a session's events are one group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([seconds, order])
        steps: list[list] = []
        for o, t, k, d in zip(frame[order], frame[seconds], frame[kind], frame[delta], strict=True):
            d = 0.0 if pd.isna(d) else float(d)
            last = steps[-1] if steps else None
            joins = (
                last is not None and k == last[0] == "scroll" and t - last[4] <= SCROLL_SECONDS and abs(d) <= SCROLL_PX and last[1] * d >= 0
            )
            if joins:
                last[1], last[3], last[4], last[5] = last[1] + d, o, t, last[5] + 1
            else:
                steps.append([k, d, o, o, t, 1])
        out = pd.DataFrame([[s[0], s[1], s[2], s[3], s[5]] for s in steps], columns=["kind", "delta", "first", "last", "n"])
        out.insert(0, "step", range(len(out)))
        out.insert(0, key, frame[key].iloc[0])
        return out

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    chosen = events.select(key, order, seconds, kind, delta)
    return chosen.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, step int, kind string, delta double, first {kinds[order]}, last {kinds[order]}, n int")


def step_text(kind: Column, selector: Column, value: Column) -> Column:
    """A step as text: its kind, what it is done to, and its value."""
    return F.when(kind == "navigate", F.concat(F.lit("navigate: "), F.coalesce(value, F.lit("")))).when(
        kind == "type", F.concat(F.lit("type '"), F.coalesce(value, F.lit("")), F.lit("' into "), F.coalesce(selector, F.lit("")))
    ).otherwise(F.trim(F.concat_ws(" ", kind, selector)))


def parsed_step(text: Column) -> Column:
    """The kind, selector and value that step_text was made of: what it leaves out is null, and an empty text
    has no kind. A value that holds "' into " ends at the last one."""
    typed, address = r"(?s)^type '(.*)' into (.*)$", r"(?s)^navigate: (.*)$"
    get = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    other = lambda g: F.nullif(F.regexp_extract(F.trim(text), r"(?s)^(\S+)\s*(.*)$", g), F.lit(""))
    pick = lambda t, n, o: F.when(text.rlike(typed), t).when(text.rlike(address), n).otherwise(o)
    none = F.lit(None).cast("string")
    return F.struct(
        pick(F.lit("type"), F.lit("navigate"), other(1)).alias("kind"), pick(get(typed, 2), none, other(2)).alias("selector"), pick(get(typed, 1), get(address, 1), none).alias("value")
    )


def action_type(action: Column, known: tuple[str, ...] = ("click", "type", "navigate", "wait", "scroll", "submit", "select")) -> Column:
    """The first word of an action up to a colon, lower-cased; unknown if it is none of those known."""
    word = F.lower(F.regexp_extract(F.trim(action), r"^([^\s:]+)", 1))
    return F.when(word.isin(*known), word).otherwise("unknown")


def workflow_packs(grams: DataFrame, gram: str, least: float = 0.0) -> DataFrame:
    """(pack_id, title, goal, steps, confidence, status) of procedures; ids are hashes of titles, steps are
    numbered; a procedure without steps raises."""
    parts = F.split(gram, " → ")
    steps = F.transform(parts, lambda a, i: F.struct(F.concat(F.lit("s"), (i + 1).cast("string")).alias("id"), a.alias("action")))
    made = grams.where(F.col("confidence") >= least).select(
        F.sha2(gram, 256).alias("pack_id"), F.col(gram).alias("title"), F.concat(F.lit("Execute workflow: "), F.col(gram)).alias("goal"), steps.alias("steps"), "confidence", F.lit("candidate").alias("status")
    )
    return made.withColumn("steps", F.when(F.size("steps") > 0, F.col("steps")).otherwise(F.raise_error(F.lit("a procedure without steps"))))


def eval_cases(packs: DataFrame) -> DataFrame:
    """(pack_id, case_id, action, expected): a case for each step of each pack."""
    rows = packs.select("pack_id", F.posexplode("steps").alias("i", "s"))
    return rows.select("pack_id", F.concat_ws("-", "pack_id", F.col("s.id")).alias("case_id"), F.col("s.action").alias("action"), F.concat(F.lit("step "), (F.col("i") + 1).cast("string"), F.lit(" done")).alias("expected"))


def receipts(entries: DataFrame, key: str, order: str, signal: str, rights: str, rate: str, redacted: Column, signed: Column) -> DataFrame:
    """(key, provenance_score, rights_status, replay_pass_rate, failing, eligible, receipt_hash) of runs: what
    their entries show, the gates, and a hash over it."""
    score = provenance.provenance_score(entries, key, signal)
    status = provenance.last_value(entries, key, order, signal, "acquire.completed", rights)
    passed = provenance.last_value(entries, key, order, signal, "eval.completed", rate)
    flags = entries.groupBy(key).agg(F.max(redacted).alias("_r"), F.max(signed).alias("_s"))
    rows = score.join(status, key, "left").join(passed, key, "left").join(flags, key)
    failing = governance.gates(F.col("provenance_score"), F.coalesce(F.col(rights), F.lit("pending")), F.coalesce(F.col(rate), F.lit(0.0)), F.lit(True), F.col("_r"), F.col("_s"))
    out = rows.select(key, "provenance_score", F.coalesce(F.col(rights), F.lit("pending")).alias("rights_status"), F.coalesce(F.col(rate), F.lit(0.0)).alias("replay_pass_rate"), failing.alias("failing"))
    body = F.concat_ws("|", F.col(key).cast("string"), F.format_number("provenance_score", 4), "rights_status", F.format_number("replay_pass_rate", 4), F.array_join("failing", ","))
    return out.withColumn("eligible", F.size("failing") == 0).withColumn("receipt_hash", F.sha2(body, 256))


def demoted(packs: DataFrame, registry: DataFrame, pack: str, artifact: str, status: str) -> DataFrame:
    """packs (pack, status) with the status after a cycle of rights: promoted ones that name an unregistered
    artifact are demoted, demoted ones that no longer do are promoted again."""
    lost = governance.unregistered(packs, registry, pack, artifact).select(pack).withColumn("_lost", F.lit(True))
    rows = packs.groupBy(pack).agg(F.first(status).alias(status)).join(lost, pack, "left")
    bad = F.coalesce("_lost", F.lit(False))
    now = F.when((F.col(status) == "promoted") & bad, "demoted").when((F.col(status) == "demoted") & ~bad, "promoted").otherwise(F.col(status))
    return rows.select(pack, F.col(status).alias("before"), now.alias("after"))


def conversation_packs(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, title, n_steps, steps) of conversations: an ask for each user's message, an answer for others;
    the title is the first message's."""
    kind = F.when(F.col(role) == "user", "ask").when(F.col(role) == "system", "instruct").otherwise("answer")
    item = F.struct(order, kind.alias("action"), F.substring(text, 1, 80).alias("value"))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"), F.min_by(text, order).alias("_t"))
    return grouped.select(key, T.title(F.col("_t")).alias("title"), F.size("_s").alias("n_steps"), F.transform("_s", lambda s: F.struct(s["action"].alias("action"), s["value"].alias("value"))).alias("steps"))


def step_taxonomy(steps: DataFrame, pack: str, text: str, least: int = 2) -> DataFrame:
    """(term, frequency, parent): terms of packs' steps; two that share steps more than by chance have the more
    frequent one (ties: the first) as the other's parent, and of several pairs the last by terms counts."""
    sets = steps.select(pack, F.monotonically_increasing_id().alias("_s"), F.explode(F.array_distinct(F.filter(T.terms(F.col(text)), lambda w: ~w.isin(T.STOP_VERBS)))).alias("term"))
    total = F.broadcast(steps.agg(F.count_distinct(pack).cast("double").alias("_n")))
    freq = sets.groupBy("term").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    listed = sets.join(freq.select("term"), "term", "left_semi").groupBy("_s").agg(F.array_sort(F.collect_list("term")).alias("_t"))
    pairs = listed.select(F.explode(F.flatten(F.transform("_t", lambda x, i: F.transform(F.slice("_t", i + 2, F.size("_t")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    counted = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    side = lambda c: freq.select(F.col("term").alias(c), F.col("frequency").alias(f"f{c}"))
    rows = counted.join(side("a"), "a").join(side("b"), "b").crossJoin(total)
    pmi = F.log2((F.col("n") / F.col("_n")) / ((F.col("fa") / F.col("_n")) * (F.col("fb") / F.col("_n"))))
    size = -F.log2(F.col("n") / F.col("_n"))
    kept = rows.where(F.when(size == 0, pmi >= 0).otherwise(pmi / F.nullif(size, F.lit(0.0)) > 0))
    up = F.col("fa") >= F.col("fb")
    parents = kept.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("term"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("parent"), F.struct("a", "b").alias("_at"))
    return freq.join(parents.groupBy("term").agg(F.max_by("parent", "_at").alias("parent")), "term", "left")


def embedded_state(html: Column, most: int = 8192) -> Column:
    """The JSON that pages carry of their state, cut; null without any."""
    found = F.regexp_extract(html, r"(?s)(?:__NEXT_DATA__[^>]*>|__INITIAL_STATE__\s*=\s*|__PRELOADED_STATE__\s*=\s*)(\{.*?\})\s*(?:;|</script>)", 1)
    return F.nullif(F.substring(found, 1, most), F.lit(""))


def unified_diff(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, diff) of two texts, line by line."""
    import difflib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = ["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), "old", "new", lineterm="")) for a, b in zip(batch["a"], batch["b"], strict=True)]
            yield pd.DataFrame({key: batch["k"], "diff": made})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(old).alias("a"), F.col(new).alias("b")).mapInPandas(run, f"{key} {kind}, diff string")


def line_diff(old: Column, new: Column) -> Column:
    """Lines of the old text that the new one lacks, then new ones, then common ones, each with its mark."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    mark = lambda c, m: F.transform(c, lambda x: F.concat(F.lit(m), x))
    return F.concat(mark(governance.list_difference(a, b), "- "), mark(governance.list_difference(b, a), "+ "), mark(F.filter(b, lambda x: F.array_contains(a, x)), "  "))


def changed_keys(old: Column, new: Column) -> Column:
    """Sorted keys of two maps whose values differ, or that one of them lacks."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k))))


def goal_met(url: Column, text: Column, url_part: str | None, text_part: str | None) -> Column:
    out = F.lit(False)
    out = out | F.coalesce(url.contains(url_part), F.lit(False)) if url_part else out
    return out | F.coalesce(F.contains(F.lower(text), F.lit(text_part.lower())), F.lit(False)) if text_part else out


def as_tool(name: str, about: str, parameters: dict[str, str]) -> str:
    """A query's description as a function that agents may call, in JSON."""
    return json.dumps({"name": name, "description": about, "parameters": {"type": "object", "properties": {k: {"type": v} for k, v in parameters.items()}, "required": list(parameters)}}, sort_keys=True)


def with_model(rows: DataFrame, schema: str, load, apply) -> DataFrame:
    """rows through a model: load() once for a worker's batches, apply(model, frame) for each; for speech,
    pictures, embeddings or ranking, whichever model is at hand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield apply(model, batch)

    return rows.mapInPandas(run, schema)


def reranked(found: DataFrame, by: str, score: Column | None = None, k: int = 10) -> DataFrame:
    """The k first of a ranking after a scorer; without one the order stays."""
    order = [F.desc("_s"), F.asc("rank")] if score is not None else [F.asc("rank")]
    rows = found.withColumn("_s", score if score is not None else F.lit(0.0))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).drop("_s")
