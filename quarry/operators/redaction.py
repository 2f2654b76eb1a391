"""Scanning for secrets and personal data, and redaction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import patterns as P

#: What near a name tells that it is a person's: fixed values.
CONTEXT = (r"(?i)\b(mr|mrs|ms|dr|prof)\.?\s", r"(?i)\b(name|patient|customer|employee|contact)\b\s*[:=]", r"(?i)\b(born|dob|ssn|passport)\b", r"(?i)\b(lives|resides|address)\b", r"(?i)\b(signed|sincerely|regards)\b")


#: Letters that patterns of any case take for i, k and s beside those of ASCII.
_FOLDED = ("\u0130", "\u0131", "\u017f", "\u212a")


def _may_match(text: Column, lower: Column, run: Column, odd: Column, signs: dict) -> Column:
    """Whether a text holds what every match of a pattern holds (`patterns.SIGNS`)."""
    out = run >= signs["run"] if "run" in signs else F.lit(True)
    for s in signs.get("all", ()):
        out = out & F.contains(text, F.lit(s))
    if "some" in signs:
        out = out & reduce(or_, [F.contains(text, F.lit(s)) for s in signs["some"]])
    if "words" in signs:
        out = out & reduce(or_, [F.contains(lower, F.lit(s)) for s in signs["words"]], odd)
    return out & text.rlike(signs["shape"]) if "shape" in signs else out


def scan_counts(docs: DataFrame, id_col: str, text_col: str, extended: bool = False) -> DataFrame:
    """(id, counts by pattern, secret_count, pii_count, redaction_required): matches of each pattern, in
    generated code; patterns see Unicode classes. A pattern runs over texts that hold its signs only."""
    found = P.active(extended)
    text = F.col("_text")
    runs = F.when(~text.rlike(r"(?U)\d"), 0)
    for shorter, n in zip(P.RUNS, P.RUNS[1:], strict=False):
        runs = runs.when(~text.rlike(rf"(?U)\d{{{n}}}"), shorter)
    odd = reduce(or_, [F.contains(text, F.lit(c)) for c in _FOLDED])
    rows = docs.select(id_col, F.col(text_col).alias("_text")).select(id_col, "_text", F.lower("_text").alias("_lower"), runs.otherwise(P.RUNS[-1]).alias("_run"), odd.alias("_odd"))
    count = lambda n, p: F.when(_may_match(text, F.col("_lower"), F.col("_run"), F.col("_odd"), P.SIGNS.get(n, {})), F.regexp_count(text, F.lit("(?U)" + p))).otherwise(0)
    rows = rows.select(id_col, *[F.coalesce(count(name, p), F.lit(0)).alias(name) for name, (_, p) in found.items()])
    total = lambda kind: sum((F.col(n) for n, (k, _) in found.items() if k == kind), F.lit(0)).cast("int")
    return rows.withColumn("secret_count", total("secret")).withColumn("pii_count", total("pii")).withColumn("redaction_required", F.col("secret_count") + F.col("pii_count") > 0)


def spans(text: str | None, compiled: dict[str, tuple[str, re.Pattern]]) -> list[tuple[int, int, str, str]]:
    """(start, end, name, category) of all matches, by start, end and name."""
    return sorted((m.start(), m.end(), name, kind) for name, (kind, p) in compiled.items() for m in p.finditer(text or ""))


def merged(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Spans that touch or overlap as one, under the name of the first."""
    out: list[tuple[int, int, str]] = []
    for a, b, name, _ in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2])
        else:
            out.append((a, b, name))
    return out


def resolved(found: list[tuple[int, int, str, str]], priority: dict[str, int] | None = None) -> list[tuple[int, int, str, str]]:
    """Findings that don't overlap: by start, longer first, then priority; one that overlaps the last kept
    and reaches further takes its place."""
    rank = priority or {}
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found, key=lambda x: (x[0], x[0] - x[1], -rank.get(x[2], 0), x[2])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
        elif x[1] > out[-1][1]:
            out[-1] = x
    return out


_FINDING = "struct<pattern_name:string,category:string,start:int,end:int,excerpt:string,context:string>"


def findings(docs: DataFrame, id_col: str, text_col: str, extended: bool = False, around: int = 50, apart: bool = False) -> DataFrame:
    """One row for each finding: (id, pattern_name, category, start, end, excerpt, context); apart leaves
    out findings that others overlap."""
    found = P.active(extended)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {n: (k, re.compile(p)) for n, (k, p) in found.items()}
        for batch in batches:
            rows = []
            for i, text in zip(batch["i"], batch["t"], strict=True):
                hits = spans(text, compiled)
                rows += [(i, n, k, a, b, text[a:b], text[max(0, a - around) : b + around]) for a, b, n, k in (resolved(hits) if apart else hits)]
            yield pd.DataFrame(rows, columns=[id_col, "pattern_name", "category", "start", "end", "excerpt", "context"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull()).mapInPandas(
        run, f"{id_col} {kind}, pattern_name string, category string, start int, end int, excerpt string, context string"
    )


def redacted(docs: DataFrame, id_col: str, text_col: str, extended: bool = False) -> DataFrame:
    """(id, text, n_redacted, redaction_rate, patterns): matches replaced by [NAME], those that touch or
    overlap once; rate is the share of characters; patterns in the order first met. Null stays null."""
    found = P.active(extended)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {n: (k, re.compile(p)) for n, (k, p) in found.items()}
        for batch in batches:
            rows = []
            for i, text in zip(batch["i"], batch["t"], strict=True):
                hits = spans(text, compiled)
                out, at = [], 0
                for a, b, name in merged(hits):
                    out += [text[at:a], f"[{name.upper()}]"]
                    at = b
                rate = min(1.0, sum(b - a for a, b, _, _ in hits) / max(1, len(text or "")))
                rows.append((i, None if text is None else "".join(out) + text[at:], len(merged(hits)), rate, list(dict.fromkeys(n for _, _, n, _ in hits))))
            yield pd.DataFrame(rows, columns=[id_col, text_col, "n_redacted", "redaction_rate", "patterns"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(
        run, f"{id_col} {kind}, {text_col} string, n_redacted int, redaction_rate double, patterns array<string>"
    )


def personal_context(text: Column, start: Column, end: Column, around: int = 120) -> Column:
    """Whether one of five signs of a person stands within so many characters of a span."""
    near = F.substring(text, F.greatest(F.lit(1), start + 1 - around), end - start + 2 * around)
    out = F.lit(False)
    for p in CONTEXT:
        out = out | near.rlike(p)
    return out
