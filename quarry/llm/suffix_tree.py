"""Language-model scoring with a probabilistic suffix tree over words.

The tree's root is the smoothed unigram model. A context of up to `depth` words becomes a state if it is
frequent enough and its next-word distribution diverges from that of its longest retained suffix (a
G-test and a least divergence). A state's distribution is the counts smoothed towards its parent; words
that it has no entry for keep the parent's proportions. A token is scored by the state of the longest
retained suffix of what precedes it.

How often is frequent enough grows with the square root of the number of training tokens, so the tree
grows with the square root of the corpus: it has at most 1 / context_root * sqrt(tokens) states of a
depth and 1 / entry_root * sqrt(tokens) entries, and a task holds it whole. All counts cover all training
texts. Words are known by 64-bit hashes; every text ends with an end token.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._words import SPACED, mix, slices, words
from quarry.session import checkpointed

END = np.uint64(0x656E64)
#: Tokens gathered before counts are handed on.
FLUSH = 4_000_000


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all tokens of the texts, ends included."""
    found = words(buf, offs, SPACED)
    n = len(offs) - 1
    text = np.concatenate([found.text_of(), np.arange(n)])
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate([found.hash, np.full(n, END)])[order]


def _counted(docs: DataFrame, text_col: str, keys, kind: str = "key long, n long") -> DataFrame:
    """(key, n) summed over texts; keys(text, token) gives the keys of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

        for batch in batches:
            for _, _, buf, offs in slices(batch.column(0)):
                own = keys(*_tokens(buf, offs))
                held.append(own)
                total += len(own)
                if total >= FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, kind).groupBy("key").agg(F.sum("n").alias("n"))


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): how often each token (by hash) occurs in all texts; null counts as an empty text."""
    return _counted(docs, text_col, lambda text, token: token)


@dataclass
class Tree:
    """States of depth k are keyed by the hash chain of their words, the latest first."""

    total: int
    distinct: int
    words: np.ndarray  # sorted hashes of the words that the tree knows by number
    counts: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)  # by depth, sorted
    scale: list[np.ndarray] = field(default_factory=list)  # log10 factor on the parent, without an entry
    entry: list[np.ndarray] = field(default_factory=list)  # sorted hashes of (state, word)
    value: list[np.ndarray] = field(default_factory=list)  # log10 probabilities

    @property
    def floor(self) -> float:
        return float(np.log10(self.total + 0.1 * (self.distinct + 1))) if self.distinct else 0.0

    def number(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.words, token)


def _find(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted value in a sorted array."""
    if not len(held):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
    return place, held[place] == wanted


def _chain(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of the context that has one more word before it."""
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0x9E3779B97F4A7C15) + word)


def _pair(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(state ^ mix(word + np.uint64(77)))


def _in_steps(text: np.ndarray, token: np.ndarray, depth: int, candidates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of contexts of a depth all of whose suffixes are candidates."""
    at = np.arange(len(token))
    key = np.zeros(len(at), np.uint64)
    for j in range(1, depth + 1):
        ok = at >= j
        at, key = at[ok], key[ok]
        ok = text[at] == text[at - j]
        at, key = at[ok], _chain(key[ok], token[at[ok] - j])
        if j <= len(candidates):
            ok = _find(candidates[j - 1], key)[1]
            at, key = at[ok], key[ok]
    return at, key


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text", depth: int = 4, context_root: float = 0.5, entry_root: float = 0.01, divergence: float = 0.02, smoothing: float = 10.0) -> Tree:
    """The tree of the texts of docs; counts is their token_counts. Contexts have context_root times the
    square root of the number of tokens or more, entries and words known by number entry_root times, and
    two at least. An empty docs gives a root whose tokens all have probability one."""
    told = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(told["n"] or 0), int(told["v"])
    least, fewest = max(2.0, context_root * total**0.5), max(2.0, entry_root * total**0.5)
    frequent = counts.where(F.col("n") >= min(fewest, least)).toArrow()
    order = np.argsort(frequent["key"].to_numpy().view(np.uint64))
    tree = Tree(total, distinct, frequent["key"].to_numpy().view(np.uint64)[order], frequent["n"].to_numpy()[order])
    often = (tree.counts >= least) & (tree.words != END)
    spark, candidates = docs.sparkSession, [_chain(np.zeros(int(often.sum()), np.uint64), tree.words[often])]
    order = np.argsort(candidates[0])
    candidates[0], sizes = candidates[0][order], tree.counts[often][order]
    line = np.zeros((len(sizes), 0), np.uint64)  # of each context, the keys of its proper suffixes
    for k in range(1, depth + 1):
        if not len(candidates[-1]):
            break
        shared = spark.sparkContext.broadcast(pickle.dumps((tree.words, tree.words[often], candidates)))

        def around(text, token, k=k, shared=shared):
            """(context, next word), and with the upper bit set (context, word before it)."""
            known, before, candidates = pickle.loads(shared.value)
            at, key = _in_steps(text, token, k, candidates)
            place, _ = _find(candidates[k - 1], key)
            word, ok = _find(known, token[at])
            out = [(place[ok].astype(np.uint64) << np.uint64(32)) | word[ok].astype(np.uint64)]
            if k < depth:
                longer = (at > k) & (text[at] == text[np.maximum(at - k - 1, 0)])
                word, ok = _find(before, token[at[longer] - k - 1])
                out.append(np.uint64(1 << 63) | (place[longer][ok].astype(np.uint64) << np.uint64(32)) | word[ok].astype(np.uint64))
            return np.concatenate(out)

        table = _counted(docs, text_col, around).where(((F.col("key") >= 0) & (F.col("n") >= fewest)) | ((F.col("key") < 0) & (F.col("n") >= least))).toArrow()
        packed, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
        order = np.argsort(packed)
        cut = int(np.searchsorted(packed[order], np.uint64(1 << 63)))
        after, before = order[:cut], order[cut:]
        _grow(tree, candidates[-1], sizes, packed[after], n[after], line, divergence, smoothing)
        suffix, word = (packed[before] >> np.uint64(32)).astype(np.int64) & 0x7FFFFFFF, (packed[before] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = _chain(candidates[-1][suffix], tree.words[often][word])
        order = np.argsort(key)
        line = np.concatenate([line[suffix], candidates[-1][suffix][:, None]], axis=1)[order]
        sizes = n[before][order]
        candidates.append(key[order])
    return tree


def _grow(tree: Tree, keys: np.ndarray, sizes: np.ndarray, packed: np.ndarray, n: np.ndarray, line: np.ndarray, divergence: float, smoothing: float) -> None:
    """Adds the contexts of the next depth that pass the tests against their longest retained suffix;
    the words of no entry of a context count together as one outcome."""
    state, word = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    root = np.log10((tree.counts[word] + 0.1) / (tree.total + 0.1 * (tree.distinct + 1)))
    gain, explicit = _descend(tree, [line[state, j] for j in range(line.shape[1])], tree.words[word])
    base = 10.0 ** np.where(explicit, gain, gain + root)
    held, m = sizes[state], len(keys)
    rest_n = sizes - np.bincount(state, n, minlength=m)
    rest_p = np.maximum(1e-12, 1 - np.bincount(state, base, minlength=m))
    diverged = np.bincount(state, n * np.log(n / held / base), minlength=m)
    diverged += np.where(rest_n > 0, rest_n * np.log(np.maximum(rest_n, 1) / sizes / rest_p), 0)
    free = np.bincount(state, minlength=m)
    keep = (2 * diverged > free + 4 * np.sqrt(2 * free + 1)) & (diverged / sizes > divergence)
    p = (n + smoothing * base) / (held + smoothing)
    rest = np.maximum(1e-9, 1 - np.bincount(state, p, minlength=m))
    of = keep[state]
    pair = _pair(keys[state[of]], tree.words[word[of]])
    order = np.argsort(pair)
    tree.keys.append(keys[keep])
    tree.scale.append(np.log10(rest / rest_p)[keep])
    tree.entry.append(pair[order])
    tree.value.append(np.log10(p[of])[order])


def _descend(tree: Tree, keys: list[np.ndarray], token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, explicit) of tokens after contexts; keys[j] are those of their last j + 1 words, 0 where
    there are fewer. From the longest state on: an entry gives the log10 probability and ends the
    search, no entry gives the state's factor and leads to the next shorter state; where none had an
    entry, the root's log10 probability has to be added."""
    gain, explicit = np.zeros(len(token)), np.zeros(len(token), bool)
    for k in range(min(len(keys), len(tree.keys)), 0, -1):
        state, found = _find(tree.keys[k - 1], keys[k - 1])
        at = np.flatnonzero(found & ~explicit)
        if not len(at):
            continue
        entry, has = _find(tree.entry[k - 1], _pair(keys[k - 1][at], token[at]))
        gain[at] += tree.scale[k - 1][state[at]] if not len(tree.entry[k - 1]) else np.where(has, tree.value[k - 1][entry], tree.scale[k - 1][state[at]])
        explicit[at[has]] = True
    return gain, explicit


def _contexts(text: np.ndarray, token: np.ndarray, depth: int) -> list[np.ndarray]:
    """The keys of each token's last 1, 2, ... words, 0 where the text has fewer before it."""
    out, key, fits = [], np.zeros(len(token), np.uint64), np.ones(len(token), bool)
    for j in range(1, depth + 1):
        fits[:j] = False
        fits[j:] &= text[j:] == text[:-j]
        longer = np.zeros(len(token), np.uint64)
        longer[j:] = _chain(key[j:], token[:-j])
        key = np.where(fits, longer, np.uint64(0))
        out.append(key)
    return out


def score(docs: DataFrame, tree: Tree, counts: DataFrame, id_col: str, text_col: str, flag: Column) -> DataFrame:
    """(id, flag, n_tokens, n_known, base_score, score) for each row of docs.

    Words that the tree knows by number are scored in place; the others travel once, as (row, word),
    to their counts. A row goes by the hash of its id and text, which stays the same when a task runs
    again; rows that repeat both are scored together, and each gets its copy. Null texts count as
    empty: one end token. Null ids stay."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(tree))
    floor = tree.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(shared.value)
        logs = np.log10(tree.counts + 0.1)
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(3)):
                text, token = _tokens(buf, offs)
                n = hi - lo
                place, known = tree.number(token)
                root = np.where(known, logs[place] if len(logs) else 0.0, 0.0)
                gain, explicit = _descend(tree, _contexts(text, token, len(tree.keys)), token)
                total = lambda v, text=text, n=n: np.bincount(text, v, minlength=n)
                base = total(root)
                better = total(np.where(explicit, gain + floor, root + gain))
                rare = np.flatnonzero(~known)
                of = text[rare]
                order = np.lexsort((token[rare], of))
                of, word = of[order], token[rare][order]
                new = np.ones(len(of), bool)
                new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
                cuts = np.flatnonzero(new)
                times = np.diff(np.append(cuts, len(of)))
                rows = batch.column(0).slice(lo, n).to_numpy()
                m = len(cuts)
                none = lambda kind, m=m: pa.nulls(m, kind)
                own = mix(rows.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, rows[of[cuts]]])),
                        pa.array(np.concatenate([np.ones(n, np.int64), np.zeros(m, np.int64)])),
                        pa.concat_arrays([batch.column(1).slice(lo, n), none(pa.int64())]),
                        pa.concat_arrays([batch.column(2).slice(lo, n), none(pa.bool_())]),
                        pa.array(np.concatenate([np.bincount(text, minlength=n), np.zeros(m, np.int64)])),
                        pa.array(np.concatenate([total(known).astype(np.int64), np.zeros(m, np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(m)])),
                        pa.array(np.concatenate([better, np.zeros(m)])),
                        pa.array(np.concatenate([own, word[cuts].view(np.int64)])),
                        pa.array(np.concatenate([np.zeros(n, np.int64), times])),
                    ],
                    names=["row", "rows", "id", "flag", "n_tokens", "known", "base", "better", "key", "times"],
                )

    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), flag.alias("flag"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(run, "row long, rows long, id long, flag boolean, n_tokens long, known long, base double, better double, key long, times long")
    joined = parts.join(counts, "key", "left").withColumn("_log", F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1))
    copies = F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))
    return (
        joined.groupBy("row")
        .agg(
            F.sum("rows").alias("rows"),
            F.max("id").alias("id"),
            F.max("flag").alias("flag"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("known") + F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
            (F.sum("base") + F.sum("_log")).alias("base"),
            (F.sum("better") + F.sum("_log")).alias("better"),
        )
        .select("*", copies.alias("_copy"))
        .select(
            "id", "flag", *[F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")],
            ((F.col("base") - F.col("n_tokens") * floor) / F.col("rows")).alias("base_score"),
            ((F.col("better") - F.col("n_tokens") * floor) / F.col("rows")).alias("score"),
        )
    )


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose crc32, as text, is divisible by ten, and for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(True))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Scores all rows with a tree learnt from those that are not held out."""
    train = docs.where(~held_out(id_col))
    counts = checkpointed(token_counts(train, text_col))
    tree = fit(train, counts, text_col, **how)
    return score(docs, tree, counts, id_col, text_col, held_out(id_col)).withColumn("train_tokens", F.lit(tree.total).cast("long"))
