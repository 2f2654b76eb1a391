"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is trained on labelled findings and then read out as expressions: a candidate's score is
the share of trees that vote for it. Everything runs in built-in functions, within the row that holds
the text, so no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._columns import free

#: A whole run of token characters that holds a digit, and a value given to a name for secrets, of any
#: length; possessive, so the search stays linear.
TOKEN = r"(?<![A-Za-z0-9_+/=\-])(?=[A-Za-z_+/=\-]*+[0-9])[A-Za-z0-9_+/=\-]{20,}+"
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|credential)s?[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9_+/=!@#$%^&*.\-]{8,}+)"
#: Words that make identifiers: fixed values.
DICTIONARY = (
    "config default example sample test user name file path data value index count number string object class function method module "
    "package version release build server client request response handler manager service controller factory session cache buffer "
    "message event listener thread process system network connect timeout error warning debug info table column query select update "
    "insert delete create remove width height color image button window panel layout style script content header footer page document "
    "article section title label field input output format parse render public private static final const return import export"
).split()
#: What a place of a value has not before and behind it; elsewhere the value is a part of a longer one.
#: A value may follow the = that gives it.
NOT_BEFORE, NOT_BEHIND = r"(?<![A-Za-z0-9_+/\-])", r"(?![A-Za-z0-9_+/=\-])"
SECRET_WORDS = r"(?i)token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private"
PLAIN_WORDS = r"(?i)sha|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|example|sample|placeholder|version"
PLAIN_PATHS = r"(?i)test|example|fixture|sample|doc|mock|vendor|lock"
FEATURES = [
    "length", "digits", "upper", "symbols", "distinct", "entropy", "class_runs", "vowel_runs", "longest_run",
    "dictionary", "hex", "uuid", "placeholder", "secret_word", "plain_word", "plain_path", "assigned",
]
#: Characters of a candidate's surroundings that count as neighbours.
BEFORE, AFTER = 40, 20
TREES, DEPTH, SEED = 24, 7, 7


def neighbours(before: Column, after: Column) -> dict[str, Column]:
    """The features that a place's surroundings give, booleans."""
    return {"secret_word": before.rlike(SECRET_WORDS), "plain_word": before.rlike(PLAIN_WORDS) | after.rlike(r"(?i)^\W*(example|placeholder)")}


def features(value: Column, before: Column, after: Column, path: Column, assigned: Column) -> Column:
    """The struct of a candidate's features, all doubles."""
    n = F.greatest(F.lit(1), F.length(value))
    share = lambda inside: (n - F.length(F.regexp_replace(value, f"[{inside}]", ""))) / n
    classed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "_"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    voiced = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z]", "0"), "[aeiouy]", "v"), "[a-u]|[w-z]", "c")
    runs = lambda x: F.length(F.regexp_replace(x, r"(.)\1+", "$1")) / n
    letters = F.array_distinct(F.split(value, ""))
    occurs = F.transform(letters, lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    flag = lambda c: c.cast("double")
    words = "(?i)" + "|".join(sorted(DICTIONARY, key=len, reverse=True))
    made = {
        "length": n.cast("double"),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "symbols": share("^A-Za-z0-9"),
        "distinct": F.size(letters) / n,
        "entropy": F.aggregate(occurs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "class_runs": runs(classed),
        "vowel_runs": runs(voiced),
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit(r"((.)\2*)"), F.lit(1)), lambda x: F.length(x))), F.lit(0)) / n,
        "dictionary": (n - F.length(F.regexp_replace(value, words, ""))) / n,
        "hex": flag(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "placeholder": flag(value.rlike(r"(?i)x{4,}|0{6,}|1234567|abcdef|your|example|changeme|placeholder|(.)\1{5}")),
        **{name: flag(c) for name, c in neighbours(before, after).items()},
        "plain_path": flag(path.rlike(PLAIN_PATHS)),
        "assigned": flag(assigned),
    }
    return F.struct(*[F.coalesce(made[x].cast("double"), F.lit(0.0)).alias(x) for x in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """(value, before, after, path, assigned, label): findings of known kinds, made by rule from hashes
    of their numbers, so the same for everyone. Half are secrets."""
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    hexed = lambda salt, m: F.substring(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 512), 1, m)
    coded = lambda salt, m: F.substring(F.translate(F.base64(F.unhex(hexed(salt, 120))), "\n", ""), 1, m)
    words = F.array(*map(F.lit, DICTIONARY))
    word = lambda salt: F.element_at(words, draw(salt, len(DICTIONARY)) + 1)
    pick = lambda salt, *options: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in options]), draw(salt, len(options)) + 1)
    secret = pick("s", hexed("a", 40), hexed("b", 32), hexed("b2", 64), coded("c", 40), coded("d", 24), coded("d2", 64), F.concat(F.lit("AKIA"), F.upper(hexed("e", 16))), F.concat(F.lit("ghp_"), F.translate(coded("f", 36), "+/=", "abc")))
    names = ("token", "secret", "password", "api_key", "access_key", "auth token", "credential", "client secret")
    given = F.concat(pick("t0", "", "the ", "my ", "set ", "export "), pick("t", *names), pick("u", " = \"", ": ", "=", " := '", " = '"))
    identifier = F.concat_ws("_", word("w"), word("x"), word("y"), word("z"), draw("i", 100).cast("string"))
    uuid = F.regexp_replace(hexed("j", 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    blank = pick("k", "xxxxxxxxxxxxxxxxxxxx1234", "00000000000000000000000000", "your_api_key_goes_here_1", "1234567890123456789012", "changeme_changeme_00000001", "EXAMPLE0EXAMPLE0EXAMPLE0")
    digest = pick("l", hexed("m", 40), hexed("n", 64), hexed("o", 32))
    about = pick("p", "commit ", "sha256: ", "md5 checksum ", "etag=", "integrity sha512-", "revision ", "digest: ")
    numbers = F.concat(F.lpad(draw("q", 1_000_000_000).cast("string"), 10, "7"), F.lpad(draw("r", 1_000_000_000).cast("string"), 12, "3"))
    prose = F.concat(word("g1"), word("g2"), word("g3"), word("g4"), draw("h", 10).cast("string"))
    kind = draw("kind", 6)
    false = F.when(kind == 0, identifier).when(kind == 1, uuid).when(kind == 2, blank).when(kind == 3, digest).when(kind == 4, numbers).otherwise(prose)
    around = F.when(kind == 3, about).when((kind == 2) & (draw("gg", 2) == 0), given).otherwise(pick("ab", "in ", "see ", "call ", "id ", "order ", "the ", "from "))
    true = F.col("id") % 2 == 0
    rows = spark.range(0, n, 1, 1).withColumn("true", true)
    named = F.when(true, F.when(draw("bare", 5) == 0, pick("ac", "and ", "see ", "uses ")).otherwise(given)).otherwise(around)
    return rows.select(
        F.when(true, secret).otherwise(false).alias("value"),
        named.alias("before"),
        pick("ad", "\"", " ", "'", "\n", ";").alias("after"),
        pick("ae", "src/app", "src0", "lib/core", F.when(true, "deploy").otherwise("tests/unit")).alias("path"),
        named.rlike("(?i)(" + "|".join(names) + ")\\W").alias("assigned"),
        true.cast("double").alias("label"),
    )


def train(findings: DataFrame) -> list:
    """The trees of a forest trained on labelled findings, as nested (feature, limit, left, right)
    with class numbers at the leaves."""
    made = findings.select("label", features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), F.col("assigned")).alias("f")).select("label", "f.*")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(made).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(data)
    return [_parsed(x.toDebugString) for x in forest.trees]


def _parsed(text: str):
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(at: int):
        if found := re.match(r"Predict: (\S+)", lines[at]):
            return float(found[1]), at + 1
        found = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        left, at = node(at + 1)
        right, at = node(at + 1)  # past the Else line
        return (int(found[1]), float(found[2]), left, right), at

    return node(0)[0]


def vote(trees: list, made: Column | dict[str, Column]) -> Column:
    """The share of trees that call a candidate, a struct or dict of features, a secret."""

    def expression(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        at, limit, left, right = tree
        return F.when(made[FEATURES[at]] <= limit, expression(left)).otherwise(expression(right))

    total = expression(trees[0])
    for tree in trees[1:]:
        total = total + expression(tree)
    return total / len(trees)


def with_findings(docs: DataFrame, trees: list, text_col: str = "text", path_col: str | None = "source", least: float = 0.5) -> DataFrame:
    """docs with a column findings: one (value, start, times, assigned, score, is_secret) for each
    different candidate of the whole text, in order of its first place (1 for the first character);
    an empty array for null and empty texts. Every place of a value is judged by its own neighbours, and
    the highest vote counts. path_col names the column of the text's path. A docs column named findings
    stays, and the added one gets an underscore behind its name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given_, any_, placed_, starting_, described_, scored_, out = (free(x, docs.columns) for x in ("_given", "_any", "_placed", "_starting", "_described", "_scored", "findings"))
    given = F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1))
    found = docs.withColumn(given_, given).withColumn(any_, F.array_distinct(F.concat(given_, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))))
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col else F.lit("")

    def places(v: Column) -> Column:
        """What lies before, between and behind the places of a value, as lengths."""
        between = F.split(text, F.concat(F.lit(NOT_BEFORE + r"\Q"), v, F.lit(r"\E" + NOT_BEHIND)))
        return F.transform(between, lambda x: F.length(x))

    def placed(v: Column) -> Column:
        return F.struct(
            v.alias("value"), F.position(v, text).alias("start"),
            ((F.length(text) - F.length(F.replace(text, v, F.lit("")))) / F.length(v)).cast("int").alias("times"),
            F.array_contains(given_, v).alias("assigned"), places(v).alias("between"),
        )

    def starting(x: Column) -> Column:
        # running sums as (end of the last place, starts so far); the piece behind the last place starts none
        step = lambda a, n: F.struct((a["end"] + n + F.length(x["value"])).alias("end"), F.concat(a["starts"], F.array(a["end"] + n + 1)).alias("starts"))
        none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.slice(x["between"], 1, F.size(x["between"]) - 1), none, step, lambda a: a["starts"])
        return F.struct(*[x[c].alias(c) for c in ("value", "start", "times", "assigned")], starts.alias("starts"))

    def described(x: Column) -> Column:
        def around(start: Column) -> Column:
            before = F.substring(text, F.greatest(F.lit(1), start - BEFORE), F.least(F.lit(BEFORE), start - 1))
            made = neighbours(before, F.substring(text, start + F.length(x["value"]), F.lit(AFTER)))
            return F.struct(*[c.cast("double").alias(name) for name, c in made.items()])

        none = F.lit("")
        kinds = F.array_distinct(F.transform(F.when(F.size(x["starts"]) > 0, x["starts"]).otherwise(F.array(x["start"])), around))
        return F.struct(*[x[c].alias(c) for c in ("value", "start", "times", "assigned")], kinds.alias("kinds"), features(x["value"], none, none, path, x["assigned"]).alias("f"))

    def scored(x: Column) -> Column:
        own = lambda k: {name: k[name] if name in neighbours(F.lit(""), F.lit("")) else x["f"][name] for name in FEATURES}
        most = F.array_max(F.transform(x["kinds"], lambda k: vote(trees, own(k))))
        return F.struct(*[x[c].alias(c) for c in ("value", "start", "times", "assigned")], most.alias("score"))

    def decided(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("value", "start", "times", "assigned", "score")], (x["score"] > least).alias("is_secret"))

    found = found.withColumn(placed_, F.transform(any_, placed)).withColumn(starting_, F.transform(placed_, starting))
    found = found.withColumn(described_, F.transform(starting_, described))
    found = found.withColumn(scored_, F.transform(described_, scored)).withColumn(out, F.array_sort(F.transform(scored_, decided), lambda a, b: a["start"] - b["start"]))
    return found.drop(given_, any_, placed_, starting_, described_, scored_)


def redacted(docs: DataFrame, trees: list, text_col: str = "text", path_col: str | None = "source", marker: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """docs with every secret replaced by the marker, wherever it stands in the text, longest first;
    other columns, whatever their names, and texts without secrets, stay as they are. length_col, if
    given, gets the new length in characters where the text changes."""
    found = with_findings(docs, trees, text_col, path_col)
    held, new = free("_values", found.columns), free("_text", found.columns)
    values = F.transform(F.filter(found.columns[-1], lambda x: x["is_secret"]), lambda x: x["value"])
    found = found.withColumn(held, F.array_sort(values, lambda a, b: F.length(b) - F.length(a)))
    text = F.when(F.size(held) > 0, F.aggregate(held, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(marker)))).otherwise(F.col(text_col))
    out = found.withColumn(new, text)
    if length_col:
        out = out.withColumn(length_col, F.when(F.size(held) > 0, F.length(new)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.col(new)).select(docs.columns)
