"""Quality rules by distribution divergence, in built-in functions only.

A text's histogram of character classes and its histogram of common words are compared with those of
its language, summed over all texts of that language, by Jensen-Shannon distance (base 2, 0 to 1).
Texts with too few characters, or too few words, are not judged by that histogram. The limit on the distance
of common words follows from the language and from the length: it is a share of the distance that a
text without any common word has, and more for short texts, whose counts differ by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed

#: Common words of each language: fixed values.
COMMON = {
    "en": "the of and to in that is was for with on by are be from".split(),
    "de": "der die und in den von zu das mit sich des auf ist im nicht".split(),
    "fr": "de la le les et des en un une que est pour dans qui du".split(),
    "es": "de la que el en los las por con para una se del no su".split(),
}
WORDS = sorted({w for x in COMMON.values() for w in x})
#: Character classes, as the inside of a bracket expression; the last class is all else.
CLASSES = ("a-z", "A-Z", "0-9", " \\t\\n\\x0B\\f\\r", ".,;:!?'\"()\\-", "#*$%&|<>")
#: Least characters and words for a histogram to count; largest distance of classes kept; the largest one of
#: common words as a share of that of a text without any, for a text of endless length.
LEAST_CHARS, LEAST_WORDS, MOST_CLASS, MOST_SHARE = 300, 50, 0.28, 0.6
#: What chance adds to the square of that limit, for a text of one word: twice the expected divergence of a
#: sample from its source, 16 / (8 ln 2 n) for sixteen common words and n words.
CHANCE = 2 * 16 / (8 * 0.6931471805599453)

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: Column) -> Column:
    """The words of a text: runs without ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def with_repeated_words(rows: DataFrame, words_col: str, out: str, k: int = 5) -> DataFrame:
    """Adds how many words of an array lie in a window of k words that occurs twice or more in it.

    Each step is a projection of its own, so that an array which a lambda looks into is computed
    once. Only where some window repeats are the windows sorted: equal ones are neighbours then, and
    their places, sorted, give what they cover."""
    n, windows, placed, at = F.size(words_col), F.col("_windows"), F.col("_placed"), F.col("_at")
    rows = rows.withColumn("_hashes", F.transform(words_col, lambda w: F.xxhash64(w)))
    rows = rows.withColumn(
        "_windows",
        F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(k)]))),
    )
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    rows = rows.withColumn("_placed", F.when(repeats, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = lambda x, p: (F.get(placed, p - 1)["h"] == x["h"]) | (F.get(placed, p + 1)["h"] == x["h"])
    rows = rows.withColumn("_at", F.array_sort(F.transform(F.filter(placed, again), lambda x: x["i"])))
    covered = F.aggregate(at, F.lit(0), lambda n, i: n + F.lit(k)) - _overlap(at, k)
    return rows.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_hashes", "_windows", "_placed", "_at")


def _overlap(at: Column, k: int) -> Column:
    """What windows of k at ascending places have in common with their predecessors."""
    gaps = F.transform(at, lambda i, p: F.greatest(F.lit(0), k - (i - F.coalesce(F.get(at, p - 1), F.lit(-k)))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes, commons):
    the counts of each row's whole text. A null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    split = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"),
        words(text).alias("words"), lines.alias("lines"),
    )
    split = with_repeated_words(split, "words", "n_repeat_words")
    count = lambda inside: F.length("text") - F.length(F.regexp_replace("text", f"[{inside}]+", ""))
    common = split.select(
        "id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.length("text").cast("long").alias("n_chars"),
        F.array(*[count(x) for x in CLASSES]).alias("counted"),
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(WORDS)).alias("common"),
    )
    total = F.aggregate("counted", F.lit(0), lambda a, x: a + x)
    each = [F.size("common") - F.size(F.array_remove("common", x)) for x in WORDS]
    return common.select(
        "id", "lang", "n_words", "word_chars",
        F.get("counted", F.lit(5)).cast("long").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", "n_chars",
        F.concat("counted", F.array((F.col("n_chars") - total).cast("int"))).alias("classes"),
        F.array(*each, (F.col("n_words") - F.size("common")).cast("int")).alias("commons"),
    )


def distance(counts: Column, total: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of a histogram of counts, their total given, and one of shares. Both
    have to sum up; total is a column and no expression over the array, which the lambda would
    compute again for every class."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(counts, reference, lambda a, q: part(a / total, q) + part(q, a / total))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2))


def word_limit(rest: Column, n: Column) -> Column:
    """The largest distance of common words kept, for a language of which a share `rest` is no common words
    and a text of n words."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    bare = (part(F.lit(1.0), rest) + part(rest, F.lit(1.0)) + (1 - rest)) / 2  # a text of none: all of it is rest
    return F.sqrt(F.lit(MOST_SHARE**2) * F.greatest(F.lit(0.0), bare) + F.lit(CHANCE) / n)


def references(counts: DataFrame) -> DataFrame:
    """(lang, ref_classes, ref_commons): shares over all texts of a language that the base rules pass; a
    null language is one of its own."""
    sums = lambda column, total, size: F.array(*[F.sum(F.get(column, F.lit(i))) / F.nullif(F.sum(total), F.lit(0)) for i in range(size)])
    return (
        counts.where(~base_failed()).groupBy("lang")
        .agg(sums("classes", "n_chars", len(CLASSES) + 1).alias("ref_classes"), sums("commons", "n_words", len(WORDS) + 1).alias("ref_commons"))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts of every row with class_distance, word_distance (null where the text is too short to
    be judged by them), word_limit, base_failed and kept. The counts are written once to the shared folder and read
    for the references and the verdicts. The references have a row for each language; the join with
    them is broadcast by Spark only while they are small."""
    counts = checkpointed(base_counts(docs, id_col, text_col, lang_col))
    joined = counts.join(references(counts).withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    none = F.lit(None).cast("double")
    marked = joined.withColumns(
        {
            "class_distance": F.when((F.col("n_chars") >= LEAST_CHARS) & F.col("ref_classes").isNotNull(), distance(F.col("classes"), F.col("n_chars"), F.col("ref_classes"))).otherwise(none),
            "word_distance": F.when((F.col("n_words") >= LEAST_WORDS) & F.col("ref_commons").isNotNull(), distance(F.col("commons"), F.col("n_words"), F.col("ref_commons"))).otherwise(none),
            "base_failed": base_failed(),
            "word_limit": F.when(F.col("n_words") > 0, word_limit(F.get("ref_commons", F.lit(len(WORDS))), F.col("n_words"))),
        }
    )
    odd = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    return marked.withColumn("kept", ~F.col("base_failed") & ~odd).drop("_lang", "ref_classes", "ref_commons")
