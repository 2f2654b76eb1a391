"""Phrase collocation mining by level-wise passes (Apriori).

A text is cut into pieces at punctuation and line ends, and pieces into words. The first pass counts words;
pass k counts phrases of k words, but only those whose first k - 1 and last k - 1 words are both frequent.
Which are is broadcast as a table of bits of bounded size, a bit for each hash value: a bit that two
phrases share lets a phrase be counted in vain, and never drops one, as the counts decide what is
frequent. A phrase is known by the ids of its two parts, whose texts and counts the table of the
level before has; so the counts of all its first and last words come along, and every cut of a
phrase is scored from its own row.

Everything is counted for each language apart: a word's id is a 64-bit hash of its language and itself.
Words are counted by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._words import Lexer, mix, slices, words
from quarry.session import checkpointed, small_batches

LEAST, LONGEST, MOST, SCALE = 100, 5, 2000, 1000
#: Hands to which a language's phrases are dealt before its best are found.
HANDS = 64
#: Words that a task gathers before it hands their counts on; phrases found that are summed together, and
#: counts that a task holds before it hands them on.
FLUSH, RUN, HELD = 1_000_000, 1 << 18, 1 << 20
#: Bits of the broadcast table for each frequent phrase, and the most there are (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28

_BREAK = np.zeros(256, np.int32)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
_KEEP = _BREAK == 0
_KEEP[[0x20, 0x09]] = False
_PIECES = Lexer(_KEEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _chain(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The id of a phrase from those of all but its last word and all but its first."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + (last ^ (last >> np.uint64(32))))


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(words, ids, joined, lo) of a batch's slices; joined[i]: word i + 1 follows word i in the same
    piece; lo: the slice's first row."""
    langs = batch.column("lang_id").to_numpy().view(np.uint64)
    for lo, hi, buf, offs in slices(batch.column("text")):
        found = words(buf, offs, _PIECES)
        if not len(found.hash):
            continue
        text, piece = found.text_of(), np.cumsum(_BREAK[buf])[found.start]
        ids = mix(found.hash ^ langs[lo:hi][text])
        yield found, text, ids, (piece[1:] == piece[:-1]) & (text[1:] == text[:-1]), lo


def _spelled(found, at: np.ndarray) -> pa.Array:
    """The words at these places, A-Z lowered."""
    start, sizes = found.start[at], (found.end - found.start)[at]
    ends = np.cumsum(sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(start, sizes)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[found.buf[place]])])


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_id"), F.col(text_col).cast("string").alias("text"))


def _words_of(texts: DataFrame) -> DataFrame:
    """(lang, word, id, n): how often each word occurs; in the row without a word, all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            ids, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            spelled, langs = (pa.chunked_array([x[i] for x in held]).combine_chunks() for i in (2, 3))
            _, first, group = np.unique(ids, return_index=True, return_inverse=True)
            total = np.bincount(group, n).astype(np.int64)
            own = pa.RecordBatch.from_arrays([langs.take(pa.array(first)), spelled.take(pa.array(first)).cast(pa.large_string()), pa.array(ids[first].view(np.int64)), pa.array(total)], names=["lang", "word", "id", "n"])
            yield own
            whole = pa.table({"lang": own.column("lang"), "n": own.column("n")}).group_by("lang").aggregate([("n", "sum")])
            k = whole.num_rows
            yield pa.RecordBatch.from_arrays([whole["lang"].combine_chunks(), pa.nulls(k, pa.large_string()), pa.nulls(k, pa.int64()), whole["n_sum"].combine_chunks()], names=["lang", "word", "id", "n"])
            held, size = [], 0

        for batch in batches:
            for found, text, ids, _, lo in _read(batch):
                own, first, n = np.unique(ids, return_index=True, return_counts=True)
                held.append((own, n, _spelled(found, first), batch.column("lang").take(pa.array(text[first] + lo)).cast(pa.large_string())))
                size += len(own)
                if size >= FLUSH:
                    yield from flush()
        yield from flush()

    parts = texts.mapInArrow(run, "lang string, word string, id long, n long")
    return parts.groupBy("lang", "word").agg(F.max("id").alias("id"), F.sum("n").alias("n"))


def _bits(ids: DataFrame, n: int) -> bytes:
    """A bit for each of n ids, gathered as words of 64 bits, which the driver gets: MOST_BITS / 64 rows at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    place = F.col("id").bitwiseAND(F.lit(bits - 1))
    marked = ids.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"))
    found = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[found["word"].to_numpy()] = found["bits"].to_numpy()
    return held.astype("<i8").tobytes()


def _summed(parts: list[tuple]) -> tuple:
    """(first, last, n) of several such arrays as one, a row for each phrase."""
    first, last, n = (np.concatenate([x[i] for x in parts]) for i in range(3))
    _, at, group = np.unique(_chain(first, last), return_index=True, return_inverse=True)
    return first[at], last[at], np.bincount(group, n, len(at)).astype(np.int64)


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The counts of the phrases found. They are summed in runs of RUN, and these when there are HELD counts: so
    a task holds as many rows as it has different phrases, up to HELD, and not all that it found."""
    fresh, sums = [], []
    size = lambda parts: sum(len(x[0]) for x in parts)

    def handed() -> Iterator[pa.RecordBatch]:
        first, last, n = sums.pop()
        yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(last.view(np.int64)), pa.array(n)], names=["first", "last", "n"])

    for first, last in found:
        fresh.append((first, last, np.ones(len(first), np.int32)))
        if size(fresh) < RUN:
            continue
        sums, fresh = [*sums, _summed(fresh)], []
        if size(sums) >= HELD:
            sums = [_summed(sums)]
            if size(sums) >= HELD // 2:
                yield from handed()
    if fresh or sums:
        sums = [_summed([*sums, *fresh])]
        yield from handed()


def _phrases_of(texts: DataFrame, k: int, frequent: bytes) -> DataFrame:
    """(first, last, n): how often each phrase of k words occurs whose first and last k - 1 words have
    their bits set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(found(batches))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = np.frombuffer(shared.value, np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            for _, _, ids, joined, _ in _read(batch):
                at = np.arange(len(ids))  # where phrases of a length begin, in order, with their ids
                for length in range(2, k + 1):
                    if length == k:
                        place = ids & mask
                        ok = bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
                        at, ids = at[ok], ids[ok]
                    follows = (at[1:] == at[:-1] + 1) & joined[at[:-1]] if len(at) else np.zeros(0, bool)
                    first, last = ids[:-1][follows], ids[1:][follows]
                    if length < k:
                        at, ids = at[:-1][follows], _chain(first, last)
                if len(first):
                    yield first, last

    parts = texts.mapInArrow(run, "first long, last long, n long")
    return parts.groupBy("first", "last").agg(F.sum("n").alias("n"))


def _with_id(found: DataFrame) -> DataFrame:
    """The rows with the id of each phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_numpy().view(np.uint64) for c in ("first", "last"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_chain(first, last).view(np.int64))], names=[*batch.schema.names, "id"])

    return found.mapInArrow(run, "first long, last long, n long, id long")


def levels(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the phrases of 1, 2, ... words that occur `least` times or more: (lang, phrase, word (the
    last), id, n, first, last, heads, tails); heads are the counts of the first 1, 2, ... words, tails
    those of the last. And (lang, total): all words of each language. There are no tables behind the first
    that has no rows."""
    texts = _texts(docs, lang_col, text_col)
    counted = checkpointed(_words_of(texts).where((F.col("n") >= least) | F.col("word").isNull()))
    total = counted.where("word is null").select("lang", F.col("n").alias("total"))
    none = F.lit(None).cast("long")
    own = F.array("n")
    made = [counted.where("word is not null").select("lang", F.col("word").alias("phrase"), "word", "id", "n", none.alias("first"), none.alias("last"), own.alias("heads"), own.alias("tails"))]
    for k in range(2, longest + 1):
        n = made[-1].count()
        if not n:
            break
        found = _with_id(_phrases_of(texts, k, _bits(made[-1], n)).where(F.col("n") >= least))
        first = made[-1].select("lang", F.col("phrase").alias("_head"), F.col("id").alias("first"), "heads")
        last = made[-1].select("word", F.col("id").alias("last"), "tails")
        joined = found.join(first, "first").join(last, "last")
        own = F.array("n")
        made.append(checkpointed(joined.select(
            "lang", F.concat_ws(" ", "_head", "word").alias("phrase"), "word", "id", "n", "first", "last", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails")
        )))
    return made, total


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `most` phrases of two words or more
    that score best, among those that occur `least` times and are not part of a longer one that occurs as often.

    a, l and r count the phrase and the two parts of its worst cut, n all words of the language; the
    score is floor(SCALE * a * n / (l * r)), exact for counts of any size. Ties go by a, then by the phrase's bytes. Null
    texts are empty, null languages are "und"; a repeated row counts again; a text of any length is read
    whole. An empty table gives no rows. Other columns are not read. No task holds the counts of a
    language: words and phrases are summed within tasks, then by their keys; a language's best are
    found among those of HANDS parts."""
    made, total = levels(docs, lang_col, text_col, least, longest)
    exact = lambda x: x.cast("decimal(19,0)")
    parts = []
    for k, table in enumerate(made[1:], 2):
        count = exact(F.col("n")) * exact(F.col("total"))
        cuts = [F.struct(F.expr(f"({SCALE}BD * _product) div (cast(heads[{j - 1}] as decimal(19,0)) * cast(tails[{k - j - 1}] as decimal(19,0)))").alias("score"), F.lit(j).alias("cut"), F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
        scored = table.join(total, "lang").withColumn("_product", count).select("lang", "phrase", "id", "n", "total", F.array_min(F.array(*cuts)).alias("c"))
        if k < len(made):
            longer = made[k].select(F.explode(F.array("first", "last")).alias("id"), F.col("n").alias("within")).groupBy("id").agg(F.max("within").alias("within"))
            scored = scored.join(longer, "id", "left").where("within is null or within < n").drop("within")
        parts.append(scored)
    if not parts:
        return total.select("lang", F.lit(0).cast("long").alias("rank"), F.lit("").alias("phrase"), *[F.col("total").alias(c) for c in ("a", "l", "r", "n", "score")]).limit(0)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    order = [F.desc("score"), F.desc("n"), F.col("phrase")]
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    rows = out.select("lang", "phrase", "n", "total", "c.score", "c.l", "c.r", F.pmod(F.col("id"), F.lit(HANDS)).cast("int").alias("hand"))
    # the best of each hand of a language first, so that however many tasks there are, few rows meet
    few = rows.withColumn("rank", best("lang", "hand")).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", best("lang")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
