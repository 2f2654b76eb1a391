"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of keywords: fixed values.
STOP_WORDS = (
    "the a an and or but in on at to for of with is are was were be been have has had do does did will would "
    "could should may might this that these those it its by from as not no"
).split()
#: Verbs of user actions left out of taxonomy terms: fixed values.
STOP_VERBS = "click type press move scroll wait navigate open close select drag drop hover".split()


def ascii_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; a null text gives null, an empty one none."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Words of three or more characters that begin with a letter."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_\-]{2,}"), F.lit(0))


def flat(text: Column) -> Column:
    """The lower-cased text, trimmed, with white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def char_shingles(text: Column, k: int = 5) -> Column:
    """The set of k-character substrings of the lower-cased text with white space collapsed; a shorter
    text is its own only shingle."""
    flat_ = flat(text)
    # a look-ahead finds all overlapping runs in one pass over the text
    return F.when(F.length(flat_) < k, F.array(flat_)).otherwise(F.array_distinct(F.regexp_extract_all(flat_, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))))


def word_shingles(tokens: Column, k: int = 4) -> Column:
    """The set of k-word shingles; fewer than k words are shingles themselves."""
    n = F.size(tokens)
    joined = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.array_distinct(F.when(n < k, tokens).otherwise(joined))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences: cut after . ! or ? before white space, and at line ends."""
    cut = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(cut, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda s: F.trim(s)), lambda s: s != "")


def title(text: Column) -> Column:
    """The first heading, else the first sentence up to 120 characters, else 80 characters."""
    flat = F.trim(text)
    heading = F.trim(F.regexp_extract(flat, r"(?m)^#{1,6}\s+(.+)$", 1))
    first = F.trim(F.get(F.split(flat, r"(?<=[.!?])\s+", 2), F.lit(0)))
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(F.substring(first, 1, 120), F.lit("")), F.substring(flat, 1, 80))


def normalised_name(name: Column) -> Column:
    """The key under which names are the same: white space collapsed, trimmed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def strip_tags(html: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def unescape(text: Column) -> Column:
    """The five common HTML entities, &amp; last."""
    out = text
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def type_token_coherence(text: Column) -> Column:
    """Coherence of a chunk from its type-token ratio over words longer than three characters: 1 under
    four words or between 0.3 and 0.7, falling off outside."""
    words = F.filter(unicode_tokens(text), lambda w: F.length(w) > 3)
    ratio = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    graded = F.when(ratio < 0.3, ratio / 0.3).when(ratio > 0.7, (1 - ratio) / 0.3).otherwise(1.0)
    return F.round(F.when(F.size(words) < 4, 1.0).otherwise(graded), 3)
