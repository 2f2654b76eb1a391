"""Quality classifier: a text's own evidence, corrected by its site's record.

A logistic model on counts of the whole text, and on what its words say, gives each document's evidence.
What a word says is the log ratio of the shares of good and bad texts that hold it, by hashed words; a text's
words say their mean. To be fitted on, a labelled text's words are judged by the other half of the
labelled texts, so no text speaks for itself. Labelled outcomes are
counted by host and by path within the host; a path's rate of good documents is shrunk towards its
host's, a host's towards the overall rate, as far as few labels call for (beta-binomial, strengths by
the method of moments). The posterior odds are those of the text times those of the site relative to
the overall odds. A site's record is that of all its labels, those of the judged document included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm._columns import free
from quarry.llm._words import SPACED, slices, words
from quarry.session import small

#: Most labelled rows that the model is fitted on; most sites whose rates are broadcast.
FIT_ROWS, BROADCAST_SITES = 20_000, 50_000
#: Documents of a posterior below this go; bounds of a prior's strength.
LEAST_GOOD, STRENGTHS = 0.5, (5.0, 1000.0)
#: Numbers that measure a text, besides what its words say; values that words are hashed to.
FEATURES, BUCKETS = 12, 4096

_CLASS = np.full(256, 5, np.int64)
for _inside, _number in ((range(97, 123), 0), (range(128, 256), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, *range(9, 14)), 3), (b".,;:'\"()-?", 4)):
    _CLASS[list(_inside)] = _number


def measures(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row of numbers for each text (shares of byte classes, word lengths and repetitions), and (text,
    bucket) of its different hashed words."""
    n = len(offs) - 1
    found = words(buf, offs, SPACED)
    size, count = np.diff(offs), found.counts
    of_byte = np.repeat(np.arange(n), size)
    classes = np.bincount(of_byte * 6 + _CLASS[buf], minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
    text, length = found.text_of(), found.end - found.start
    some = np.maximum(count, 1)
    per_text = lambda v: np.bincount(text, v, minlength=n) / some
    mean = per_text(length)
    same = np.zeros(len(text), bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (text[1:] == text[:-1])
    bits = max(1, n.bit_length())
    key = np.sort((text.astype(np.uint64) << np.uint64(64 - bits)) | (found.hash >> np.uint64(bits)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(64 - bits)).astype(np.int64), minlength=n) / some
    numbers = np.column_stack(
        [classes[:, 0], classes[:, 1], classes[:, 2], classes[:, 4], classes[:, 5], np.minimum(mean, 20), per_text((length > 20)),
         per_text(same), per_text(length == 1), distinct, np.log1p(count), distinct * np.log1p(count)]
    )
    held = np.unique(text * BUCKETS + (found.hash % np.uint64(BUCKETS)).astype(np.int64))
    return numbers, held // BUCKETS, held % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # the intercept first, what words say last
    centre: np.ndarray
    scale: np.ndarray
    words: np.ndarray  # what each bucket says

    def odds(self, numbers: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        x = np.column_stack([numbers, said(self.words, text, bucket, len(numbers))])
        return (x - self.centre) / self.scale @ self.weights[1:] + self.weights[0]


def said(by_word: np.ndarray, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """The mean of what each text's words say; 0 without words."""
    return np.bincount(text, by_word[bucket], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1)


def word_ratios(text: np.ndarray, bucket: np.ndarray, good: np.ndarray, use: np.ndarray) -> np.ndarray:
    """What each bucket says by the texts in use, those that hold it smoothed by one of either kind."""
    of = use[text]
    both = []
    for kind in (1, 0):
        held = np.bincount(bucket[of & (good[text] == kind)], minlength=BUCKETS)
        both.append(np.log((held + 1) / ((use & (good == kind)).sum() + 2)))
    return both[0] - both[1]


def evidence(docs: DataFrame, model: Model, text_col: str = "text", out: str = "evidence") -> DataFrame:
    """docs with the log odds that each text is good, as column `out`; null texts count as empty."""
    names, schema = docs.columns, StructType([*docs.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col))
            made = [model.odds(*measures(buf, offs)) for _, _, buf, offs in slices(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(made) if made else np.zeros(0))], names=[*names, out])

    return docs.mapInArrow(run, schema)


def fit(numbers: np.ndarray, text: np.ndarray, bucket: np.ndarray, good: np.ndarray, half: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """A logistic model by Newton's method; half tells which of two halves a text is in. Without rows, or of
    one kind only, it gives the smoothed log odds alone."""
    odds, size = np.log((good.sum() + 1) / (len(good) - good.sum() + 1)), FEATURES + 1
    if not len(good) or good.all() or not good.any():
        return Model(np.concatenate([[odds], np.zeros(size)]), np.zeros(size), np.ones(size), np.zeros(BUCKETS))
    halves = [said(word_ratios(text, bucket, good, half != h), text, bucket, len(good)) for h in (0, 1)]
    x = np.column_stack([numbers, np.where(half == 0, *halves)])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(x.shape[1])
    w[0] = odds
    penalty = np.diag([1e-6] + [ridge] * size)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(w, centre, scale, word_ratios(text, bucket, good, np.ones(len(good), bool)))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of at most FIT_ROWS labelled documents, those of the least hashes. labels: (id, good).
    Only the measures and the buckets, as bits, of the chosen texts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                numbers, text, bucket = measures(buf, offs)
                on = np.zeros((hi - lo, BUCKETS), np.uint8)
                on[text, bucket] = 1
                bits = [x.tobytes() for x in np.packbits(on, axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(list(numbers), pa.list_(pa.float64())), pa.array(bits, pa.binary())],
                    names=["id", "good", "made", "bits"],
                )

    chosen = labels.where("good is not null and id is not null").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen.select(F.col("id").cast("long").alias("id"), F.col("good").cast("int").alias("good"))), "id")
    got = rows.select("id", "good", "text").mapInArrow(run, "id long, good int, made array<double>, bits binary").toArrow()
    got = got.sort_by([("id", "ascending"), ("good", "ascending"), ("bits", "ascending")])
    numbers = got["made"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    on = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(-1, BUCKETS // 8)
    text, bucket = np.nonzero(np.unpackbits(on, axis=1))
    return fit(numbers, text, bucket, got["good"].to_numpy().astype(int), got["id"].to_numpy() % 2)


def site_rates(outcomes: DataFrame) -> DataFrame:
    """(host, path, site_odds) for every site of outcomes (host, path, good): the log odds of its
    posterior rate less the overall ones. good is 1, 0 or null for documents without a label. Counts
    are summed before they are shuffled; null hosts and paths are sites like others."""
    paths = outcomes.groupBy("host", "path").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(((F.col("k") + 1) / (F.col("n") + 2)).alias("overall"))

    def strength(level: DataFrame, name: str) -> DataFrame:
        """One row: the strength of the prior that the spread of a level's rates calls for."""
        told = level.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("m"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq"))
        rate = F.col("k") / F.col("n")
        spread = F.col("sq") / F.col("n") - rate * rate - rate * (1 - rate) * F.col("m") / F.col("n")
        found = F.when(spread > 0, rate * (1 - rate) / F.nullif(spread, F.lit(0.0)) - 1)
        return told.select(F.greatest(F.lit(STRENGTHS[0]), F.least(F.lit(STRENGTHS[1]), F.coalesce(found, F.lit(STRENGTHS[1])))).alias(name))

    one = lambda frame: F.broadcast(frame)  # noqa: E731  a single row
    of_host = hosts.crossJoin(one(overall)).crossJoin(one(strength(hosts, "s")))
    of_host = of_host.select(F.col("host").alias("_host"), "overall", ((F.col("k") + F.col("s") * F.col("overall")) / (F.col("n") + F.col("s"))).alias("host_rate"))
    of_path = paths.join(of_host, F.col("host").eqNullSafe(F.col("_host"))).crossJoin(one(strength(paths, "s")))
    rate = (F.col("k") + F.col("s") * F.col("host_rate")) / (F.col("n") + F.col("s"))
    return of_path.select("host", "path", (log_odds(rate) - log_odds(F.col("overall"))).alias("site_odds"))


def log_odds(rate: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate))
    return F.log(held / (1 - held))


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs with evidence, site_odds (log odds) and quality, the posterior that a document is good. A docs
    column of one of these names stays, and the added one gets an underscore behind its name.

    labels: (id, good), one row for each id at most. Null and empty texts are judged as texts of no
    words. Sites are few beside documents: their rates are broadcast if at most BROADCAST_SITES of
    them are counted, else joined by a shuffle that adaptive execution splits at hot hosts."""
    model = fitted(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    rates = site_rates(own.join(labels.select("id", "good"), "id", "left"))
    said, odds, quality = added(docs.columns)
    host, path = free("host_", docs.columns), free("path_", docs.columns)
    rates = rates.select(F.col("host").alias(host), F.col("path").alias(path), F.col("site_odds").alias(odds))
    rates = F.broadcast(rates) if small(own.select("host", "path").distinct(), BROADCAST_SITES) else rates
    at_site = F.col(host_col).cast("string").eqNullSafe(F.col(host)) & F.col(path_col).cast("string").eqNullSafe(F.col(path))
    judged = evidence(docs, model, text_col, said).join(rates, at_site, "left").drop(host, path)
    return judged.withColumn(quality, 1 / (1 + F.exp(-(F.col(said) + F.coalesce(odds, F.lit(0.0))))))


def added(columns: list[str]) -> list[str]:
    """The names of the added columns."""
    return [free(x, columns) for x in ("evidence", "site_odds", "quality")]


def good_documents(docs: DataFrame, labels: DataFrame, least: float = LEAST_GOOD, **columns: str) -> DataFrame:
    """The rows of docs whose posterior reaches `least`, with the columns of docs."""
    return with_quality(docs, labels, **columns).where(F.col(added(docs.columns)[2]) >= least).select(docs.columns)
