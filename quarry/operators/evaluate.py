"""Agreement of texts: token precision and recall, ROUGE-L, grounded answers, replay reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def token_scores(pairs: DataFrame, predicted: Column, truth: Column, *keys: str) -> DataFrame:
    """(keys, precision, recall, f1, exact_match) of multisets of Unicode tokens; two texts without tokens
    agree fully, one without against one with not at all. Counts meet within the row."""
    rows = pairs.select(*keys, predicted.alias("_a"), truth.alias("_b")).select(*keys, "_a", "_b", T.unicode_tokens(F.col("_a")).alias("_p"), T.unicode_tokens(F.col("_b")).alias("_t"))
    rows = rows.withColumn("_s", F.array_intersect("_p", "_t"))
    among = lambda tokens, x: F.size(F.filter(tokens, lambda y: y == x))
    shared = F.aggregate("_s", F.lit(0), lambda acc, x: acc + F.least(among(F.col("_p"), x), among(F.col("_t"), x)))
    n, m = F.size("_p"), F.size("_t")
    rows = rows.withColumn("_n", shared)
    none = (n == 0) & (m == 0)
    rate = lambda size: F.when(none, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(F.col("_n") / size)
    out = rows.select(*keys, rate(n).alias("precision"), rate(m).alias("recall"), F.when(none, True).when((n == 0) | (m == 0), False).otherwise(F.trim("_a") == F.trim("_b")).alias("exact_match"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def lcs(a: list, b: list) -> int:
    """The length of the longest common subsequence, a row of the table at a time by bit operations."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count() if a else 0


def rouge_l(pairs: DataFrame, predicted: str, truth: str, most: int = 500) -> DataFrame:
    """pairs with rouge_l, the F-measure of the longest common subsequence of at most so many tokens."""
    word = re.compile(r"\w+")

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, t = word.findall((x or "").lower())[:most], word.findall((y or "").lower())[:most]
            if not p or not t:
                out.append(1.0 if not p and not t else 0.0)
                continue
            n = lcs(p, t)
            out.append(2 * n / (len(p) + len(t)))
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("rouge_l", score(predicted, truth))


def _share(found: Column, held: Column) -> Column:
    """The share of a set that another holds; 1 for an empty one."""
    own = F.array_distinct(found)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, held)) / F.size(own))


def tf_cosine(a: Column, b: Column) -> Column:
    """The cosine of the term frequencies of two arrays of tokens; 0 if one has none."""
    count = lambda tokens, x: F.size(F.filter(tokens, lambda y: y == x))
    square = lambda tokens: F.aggregate(F.array_distinct(tokens), F.lit(0.0), lambda acc, x: acc + count(tokens, x) * count(tokens, x))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda acc, x: acc + count(a, x) * count(b, x))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / F.sqrt(square(a) * square(b))).otherwise(0.0)


def judged(cases: DataFrame, answer: str, question: str, context: str, expected: str, rules: str | None, keys: list[str]) -> DataFrame:
    """(keys, faithfulness, relevance, context_recall, oracle, exact, overall) of each case: tokens of the
    answer in the context; cosine of answer and question; tokens of the expected text in the context;
    share of rules (regular expressions, case ignored) that match; equality. Weights .25 .25 .20 .20
    .10. A missing context or question counts as full."""
    tok = lambda c: T.ascii_tokens(F.coalesce(F.col(c), F.lit("")))
    rows = cases.select(*keys, answer, question, context, expected, *([rules] if rules else []), tok(answer).alias("_a"), tok(question).alias("_q"), tok(context).alias("_c"), tok(expected).alias("_e"))
    oracle = F.lit(1.0)
    if rules:
        passed = F.size(F.filter(rules, lambda r: F.rlike(F.col(answer), F.concat(F.lit("(?i)"), r))))
        oracle = F.when(F.coalesce(F.size(rules), F.lit(0)) == 0, 1.0).otherwise(passed / F.size(rules))
    rows = rows.withColumns(
        {
            "faithfulness": F.when(F.col(context).isNull(), 1.0).otherwise(_share(F.col("_a"), F.col("_c"))),
            "relevance": F.when(F.col(question).isNull(), 1.0).otherwise(tf_cosine(F.col("_a"), F.col("_q"))),
            "context_recall": F.when(F.col(context).isNull() | F.col(expected).isNull(), 1.0).otherwise(_share(F.col("_e"), F.col("_c"))),
            "oracle": oracle,
            "exact": F.when(F.col(expected).isNull(), 1.0).otherwise((F.trim(answer) == F.trim(expected)).cast("double")),
        }
    )
    overall = F.col("faithfulness") * 0.25 + F.col("relevance") * 0.25 + F.col("context_recall") * 0.2 + F.col("oracle") * 0.2 + F.col("exact") * 0.1
    return rows.withColumn("overall", overall).select(*keys, "faithfulness", "relevance", "context_recall", "oracle", "exact", "overall")


def run_summary(scored: DataFrame, passed: Column, faithfulness: str, relevance: str, recall: str) -> DataFrame:
    """One row: n, pass rate, means to four places, and overall (.30 .30 .20 .20)."""
    means = scored.agg(F.count("*").alias("n"), F.round(F.avg(passed.cast("double")), 4).alias("pass_rate"), *[F.round(F.avg(c), 4).alias(c) for c in (faithfulness, relevance, recall)])
    return means.withColumn("overall", F.round(F.col("pass_rate") * 0.3 + F.col(faithfulness) * 0.3 + F.col(relevance) * 0.2 + F.col(recall) * 0.2, 4))


def structured_scores(predicted: DataFrame, truth: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """(keys, field, correct) of every true field; one that is missing counts 0, equality ignores case and
    outer white space."""
    p = predicted.select(*keys, field, F.lower(F.trim(value)).alias("_p"))
    return truth.select(*keys, field, F.lower(F.trim(value)).alias("_t")).join(p, [*keys, field], "left").select(*keys, field, F.coalesce((F.col("_t") == F.col("_p")).cast("double"), F.lit(0.0)).alias("correct"))


def oracle_share(output: str | None, rules: list[str]) -> float:
    """The share of rules that match, case ignored; a rule that is no regular expression is looked for as
    it is."""
    if not rules:
        return 1.0

    def holds(rule: str) -> bool:
        try:
            return re.search(rule, output or "", re.I) is not None
        except re.error:
            return rule.lower() in (output or "").lower()

    return sum(map(holds, rules)) / len(rules)


def with_oracle_share(cases: DataFrame, output: str, rules: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [list(r) if isinstance(r, (list, np.ndarray)) else [] for r in batch[rules]]
            yield batch.assign(oracle=[oracle_share(o, r) for o, r in zip(batch[output], held, strict=True)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields)
    return cases.mapInPandas(run, f"{schema}, oracle double")


def replay_summary(steps: DataFrame, key: str, passed: str, score: str) -> DataFrame:
    """(key, n, pass_rate, mean_score): a step without a score counts 1 or 0 as it passed or not."""
    value = F.coalesce(F.col(score), F.col(passed).cast("double"))
    return steps.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(passed).cast("double")).alias("pass_rate"), F.avg(value).alias("mean_score"))


def replay_changes(old: DataFrame, new: DataFrame, key: list[str], passed: str) -> DataFrame:
    """One row: steps in both, regressions, fixes and the share that agree."""
    both = old.select(*key, F.col(passed).alias("_a")).join(new.select(*key, F.col(passed).alias("_b")), key)
    out = both.agg(F.count("*").alias("n"), F.count_if(F.col("_a") & ~F.col("_b")).alias("regressions"), F.count_if(~F.col("_a") & F.col("_b")).alias("fixes"))
    return out.withColumn("similarity", F.round(F.when(F.col("n") > 0, 1 - (F.col("regressions") + F.col("fixes")) / F.col("n")).otherwise(1.0), 4))


def step_statuses(steps: DataFrame, key: list[str], order: str, passed: str) -> DataFrame:
    """steps with status: a run's steps are executed in order until one fails; `failed` is that one, `passed` those
    before it, `skipped` those behind. A step that didn't tell (null) failed. Where a run failed is an
    aggregate joined back, so a run's steps need not meet in a task; keys are not null."""
    failed = steps.where(~F.coalesce(F.col(passed), F.lit(False))).groupBy(*key).agg(F.min(order).alias("_failed"))
    status = F.when(F.col("_failed").isNull() | (F.col(order) < F.col("_failed")), "passed").when(F.col(order) == F.col("_failed"), "failed").otherwise("skipped")
    return steps.join(failed, key, "left").withColumn("status", status).drop("_failed")


def step_report(told: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, n_steps, n_passed, n_skipped, failed_at, success) of runs with statuses; failed_at is null for a run that
    went through."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = told.groupBy(*key).agg(F.count("*").alias("n_steps"), count("passed").alias("n_passed"), count("skipped").alias("n_skipped"), F.min(F.when(F.col("status") == "failed", F.col(order))).alias("failed_at"))
    return out.withColumn("success", F.col("failed_at").isNull())
