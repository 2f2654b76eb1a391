"""Counts over texts: frequencies, weights, keywords and co-occurrence."""

from __future__ import annotations

import math
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import checkpointed, small, small_batches


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, tokens=T.ascii_tokens, only: DataFrame | None = None) -> DataFrame:
    """(id, term, n, tf): occurrences of each term of a text and their share of its tokens; with `only`, of
    the terms in its column term."""
    split = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("_t"))
    rows = split.select(id_col, F.size("_t").alias("_len"), F.explode("_t").alias("term"))
    rows = rows if only is None else rows.join(only, "term", "left_semi")
    counted = rows.groupBy(id_col, "term").agg(F.count("*").alias("n"), F.first("_len").alias("_len"))
    return counted.select(id_col, "term", "n", (F.col("n") / F.greatest("_len", F.lit(1))).alias("tf"))


def inverse_document_frequencies(frequencies: DataFrame, n_docs: int | Column) -> DataFrame:
    """(term, df, idf): smooth idf ln((n + 1) / (df + 1)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    counted = frequencies.groupBy("term").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def stop_terms(docs: DataFrame, text_col: str, top_share: float = 0.1) -> DataFrame:
    """(term, df) of the most widespread terms: the given share of all terms, at least one, by falling
    document frequency, then term. Tokens are cut at white space and lower-cased."""
    words = docs.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != ""))).alias("term"))
    counted = words.groupBy("term").agg(F.count("*").alias("df"))
    limit = counted.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * top_share)).alias("_most"))
    spread = counted.groupBy("df").agg(F.count("*").alias("_n"))
    # the least frequency that can be among the most widespread, from the short table of frequencies
    running = spread.withColumn("_up", F.sum("_n").over(Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, 0)))
    edge = running.crossJoin(F.broadcast(limit)).where(F.col("_up") >= F.col("_most")).agg(F.max("df").alias("_edge"), F.first("_most").alias("_most"))
    near = counted.crossJoin(F.broadcast(edge)).where(F.col("df") >= F.col("_edge"))
    above = near.where(F.col("df") > F.col("_edge"))
    ties = _ranked(near.where(F.col("df") == F.col("_edge")), "term")
    room = above.agg(F.count("*").alias("_above"))
    fits = ties.crossJoin(F.broadcast(room)).where(F.col("_rank") <= F.col("_most") - F.col("_above"))
    return above.select("term", "df").unionByName(fits.select("term", "df"))


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows with _rank, from 1, in the order of a column: ranked within ranges of it, which begin where those
    before end. The ranges are those of the rows as written."""
    ranged = checkpointed(rows.repartitionByRange(column).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return ranged.withColumn("_in", inner).join(starts, "_range").withColumn("_rank", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def keywords(docs: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """(id, keywords): the n most frequent terms that are no stop words, ties by first occurrence. A text
    without any has an empty array. Texts are dealt by id before they are split, so their terms are not shuffled."""
    found = docs.select(id_col, text_col).repartition(id_col).select(id_col, F.filter(T.terms(F.coalesce(F.col(text_col), F.lit(""))), lambda w: ~w.isin(T.STOP_WORDS)).alias("_t"))
    rows = found.select(id_col, F.posexplode("_t").alias("pos", "term"))
    counted = rows.groupBy(id_col, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    by = Window.partitionBy(id_col).orderBy(F.desc("n"), "first")
    top = counted.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= n)
    listed = top.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("keywords"))
    return docs.select(id_col).join(listed, id_col, "left").select(id_col, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


#: Terms of a text that are paired with as many others at a time.
BLOCK = 128
#: Terms whose table of pairs a task can hold (64 MB of counts), and texts that are added to it at once.
TABLE, TEXTS = 4096, 1024


def _in_tables(terms: DataFrame, numbered: DataFrame) -> DataFrame:
    """(_pair, n) of the numbered terms, TABLE at most: each task counts all pairs of its texts (arrays _t) in one
    table and hands on those it met, so texts are not shuffled."""
    spark = terms.sparkSession
    small_batches(spark)
    held = sorted((r["_no"], r["term"]) for r in numbered.select("_no", "term").collect())
    shared = spark.sparkContext.broadcast(([no for no, _ in held], [term for _, term in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known = np.array(shared.value[0], np.int64), pa.array(shared.value[1], pa.string())
        counts = np.zeros((len(known), len(known)), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                lists = batch.column(0).slice(at, TEXTS)
                place = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy()
                text = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                has = np.zeros((len(lists), len(known)), np.float32)
                has[text[place >= 0], place[place >= 0]] = 1
                counts += (has.T @ has).astype(np.int32)  # at most TEXTS, so floats are exact
        for i in range(len(known)):
            others = np.flatnonzero(counts[i, i + 1 :]) + i + 1
            if len(others):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[i] << 32 | numbers[others]), pa.array(counts[i, others].astype(np.int64))], names=["_pair", "n"])

    return terms.mapInArrow(run, "_pair long, n long").groupBy("_pair").agg(F.sum("n").alias("n"))


def _by_blocks(sets: DataFrame, numbered: DataFrame) -> DataFrame:
    """(_pair, n) of any number of numbered terms: a document's terms meet in blocks of BLOCK."""
    kept = sets.join(numbered.select("term", "_no"), "term")
    listed = kept.groupBy("_d").agg(F.array_sort(F.collect_list("_no")).alias("_t"))
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_t) - 1) div {BLOCK}")), lambda i: F.slice("_t", (i * BLOCK + 1).cast("int"), BLOCK))
    firsts = listed.select(cut.alias("_b")).select("_b", F.posexplode("_b").alias("_i", "_x"))
    cells = firsts.select("_x", F.explode(F.slice("_b", F.col("_i") + 1, F.size("_b"))).alias("_y")).hint("rebalance")
    pairs = cells.select("_y", F.explode("_x").alias("_a")).select("_a", F.explode("_y").alias("_c")).where("_a < _c")
    return pairs.groupBy(F.shiftleft("_a", 32).bitwiseOR(F.col("_c")).alias("_pair")).agg(F.count("*").alias("n"))


def pmi_pairs(docs: DataFrame, id_col: str, text_col: str, min_frequency: int = 2, min_pmi: float = 0.1, min_share: float = 0.0) -> DataFrame:
    """(term_a, term_b, n, pmi, npmi, freq_a, freq_b) of terms that occur together in a document more than by
    chance; npmi is 1 where a pair is in every document.

    Terms are those of at least min_frequency documents and of a share min_share of all, without action verbs. A pair
    is in no more documents than its rarer term, so its pmi is at most log2 of all documents by those of its
    commoner one: terms too common for min_pmi go before pairs are made. Those that are left are
    numbered in their order. A document's terms are paired in blocks, so a long text is dealt to many tasks;
    pairs, two numbers in one, are counted within tasks first. With a share, a document has pairs enough to
    fill the table of pairs, which then doesn't grow with the documents: if it is of TABLE terms or less, pairs are
    counted where texts are read. Null texts have no terms."""
    docs = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_x"))
    sets = docs.select("_d", F.explode(F.array_distinct(F.filter(T.terms(F.col("_x")), lambda w: ~w.isin(T.STOP_VERBS)))).alias("term"))
    n_docs = docs.count()
    often = sets.groupBy("term").agg(F.count("*").alias("freq"))
    often = often.where((F.col("freq") >= max(min_frequency, math.ceil(min_share * n_docs))) & (F.col("freq") <= n_docs * 2.0**-min_pmi))
    numbered = checkpointed(_ranked(often, "term").withColumnRenamed("_rank", "_no"))
    if small(numbered, TABLE):
        counted = _in_tables(docs.select(T.terms(F.col("_x")).alias("_t")), numbered)
    else:
        counted = _by_blocks(sets, numbered)
    side = lambda no, c, name: numbered.select(F.col("_no").alias(no), F.col("term").alias(c), F.col("freq").alias(name))
    split = counted.select(F.shiftright("_pair", 32).alias("_a"), F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("_c"), "n")
    joined = split.join(side("_a", "term_a", "_fa"), "_a").join(side("_c", "term_b", "_fb"), "_c").withColumn("_total", F.lit(float(n_docs)))
    together = F.col("n") / F.col("_total")
    pmi = F.log2(together / ((F.col("_fa") / F.col("_total")) * (F.col("_fb") / F.col("_total"))))
    scored = joined.withColumn("pmi", pmi).where(F.col("pmi") >= min_pmi)
    npmi = F.when(F.col("n") == F.col("_total"), F.lit(1.0)).otherwise(F.col("pmi") / F.nullif(-F.log2(together), F.lit(0.0)))
    return scored.select("term_a", "term_b", "n", "pmi", npmi.alias("npmi"), F.col("_fa").alias("freq_a"), F.col("_fb").alias("freq_b"))


#: Commonest terms that are counted as children in a table of each task (16 MB), shares that the other children are dealt
#: into, and numbers that are counted at once.
HEAD, DEALT, RUN = 2048, 16, 1 << 20


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def _dealt(listed: DataFrame) -> DataFrame:
    """(share, child, terms, n, at) of the arrays _t, each in the order of numbers: children below HEAD with the numbers
    before their own that they met and how often; for others a text's numbers once for each share that holds a child of it,
    with the places of these."""
    kept, shares = HEAD, DEALT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rows, held = np.zeros((kept, kept), np.int32), [], 0

        def batch() -> pa.RecordBatch:
            share, child, terms, n, at = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(share, pa.int32()), pa.array(child, pa.int32()), _lists(terms), _lists(n), _lists(at)], names=["share", "child", "terms", "n", "at"])

        none = np.zeros(0, np.int32)
        for got in batches:
            for lo in range(0, got.num_rows, TEXTS):
                lists = got.column(0).slice(lo, TEXTS)
                flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
                text = np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0))
                has = np.zeros((len(lists), kept), np.float32)
                has[text[flat < kept], flat[flat < kept]] = 1
                table += (has.T @ has).astype(np.int32)  # at most TEXTS, so floats are exact
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    own = flat[a:b]
                    rare = np.arange(np.searchsorted(own, kept), len(own), dtype=np.int32)
                    share = own[rare] % shares
                    for x in np.unique(share):
                        at = rare[share == x]
                        rows.append((x, None, own[: at[-1] + 1], none, at))
                        held += int(at[-1]) + 1
                    if held > RUN:
                        yield batch()
                        rows, held = [], 0
        for child in range(1, kept):
            terms = np.flatnonzero(table[child, :child])
            if len(terms):
                rows.append((child % shares, child, terms.astype(np.int32), table[child, terms], none))
                held += len(terms)
            if rows and (held > RUN or child == kept - 1):
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    return listed.mapInArrow(run, "share int, child int, terms array<int>, n array<int>, at array<int>")


def _best(dealt: DataFrame, steps: list[tuple[int, int]], n_docs: int, min_pmi: float) -> DataFrame:
    """(child, parent, npmi) of the rows of _dealt: of the parents whose npmi, in nine digits, is the highest of a child
    those of the least number for each frequency; steps are (frequency, the first number that has it). A task lays the
    texts' numbers on its disk and reads a child's from there."""
    firsts, freqs = np.array([x for _, x in steps], np.int64), np.array([x for x, _ in steps], np.int64)
    freq = lambda no: freqs[np.searchsorted(firsts, no, "right") - 1]

    def told(child: int, parents: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float]]:
        together, total = n / n_docs, float(n_docs)
        pmi = np.log2(together / ((freq(parents) / total) * (freq(np.array([child])) / total)))
        parents, pmi, together = parents[pmi >= min_pmi], pmi[pmi >= min_pmi], together[pmi >= min_pmi]
        if not len(parents):
            return []
        npmi = pmi / -np.log2(together)
        digits = np.round(npmi, 9)
        ties = np.flatnonzero(digits == digits.max())
        ties = ties[np.unique(freq(parents[ties]), return_index=True)[1]]
        return [(child, int(parents[i]), float(npmi[i])) for i in ties]

    def counted(child: int, pieces: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums, held, size = None, [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size > RUN:
                some = np.bincount(np.concatenate(held), minlength=child)
                sums, held, size = some if sums is None else sums + some, [], 0
        if sums is None and size < child:
            return np.unique(np.concatenate(held), return_counts=True)
        if held:
            some = np.bincount(np.concatenate(held), minlength=child)
            sums = some if sums is None else sums + some
        parents = np.flatnonzero(sums)
        return parents, sums[parents]

    def batch(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
        child, parent, npmi = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int32()), pa.array(parent, pa.int32()), pa.array(npmi, pa.float64())], names=["child", "parent", "npmi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(HEAD, np.int64))
        places, laid, rows = [np.zeros((0, 3), np.int64)], 0, []
        with tempfile.TemporaryFile() as file:
            for got in batches:
                children = got.column("child").to_pylist()
                terms, n, at = (got.column(c) for c in ("terms", "n", "at"))
                flat = terms.flatten().to_numpy()
                starts = np.cumsum(terms.value_lengths().to_numpy()) - terms.value_lengths().to_numpy()
                sums = n.flatten().to_numpy()
                begun = np.cumsum(n.value_lengths().to_numpy()) - n.value_lengths().to_numpy()
                for i, child in enumerate(children):
                    if child is not None:
                        size = len(terms[i])
                        common[child][flat[starts[i] : starts[i] + size]] += sums[begun[i] : begun[i] + size]
                which = np.repeat(starts, at.value_lengths().to_numpy())
                here = at.flatten().to_numpy().astype(np.int64)
                places.append(np.stack([flat[which + here], laid + which, here], 1))
                file.write(flat.tobytes())
                laid += len(flat)
            file.flush()
            for child, table in common.items():
                rows += told(child, np.flatnonzero(table), table[table > 0])
            place = np.concatenate(places)
            places.clear()
            place = place[np.argsort(place[:, 0], kind="stable")]
            place = place[place[:, 2] > 0]
            children, starts = np.unique(place[:, 0], return_index=True)
            for child, a, b in zip(children.tolist(), starts, np.append(starts, len(place))[1:], strict=True):
                pieces = (np.frombuffer(os.pread(file.fileno(), 4 * size, 4 * start), np.int32) for _, start, size in place[a:b].tolist())
                rows += told(child, *counted(child, pieces))
                if len(rows) > TEXTS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return dealt.mapInArrow(run, "child int, parent int, npmi double")


def best_parents(docs: DataFrame, id_col: str, text_col: str, min_frequency: int = 2, min_pmi: float = 0.1) -> DataFrame:
    """(child, parent, npmi): taxonomy_parents of pmi_pairs without a share, though pairs are not made as rows.

    Terms are numbered from the commonest on, equal ones in their order, so the parents of a child are the numbers before
    its own in a text's sorted numbers. All pairs of the HEAD commonest are counted in tables where texts are; the other
    children, each rare, are dealt into DEALT shares, and a text's numbers go once to each share that holds a child of it,
    so what is shuffled grows as the texts do. A share counts one child after another."""
    docs = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_x"))
    small_batches(docs.sparkSession)
    sets = checkpointed(docs.select("_d", F.explode(F.array_distinct(F.filter(T.terms(F.col("_x")), lambda w: ~w.isin(T.STOP_VERBS)))).alias("term")))
    n_docs = docs.count()
    often = sets.groupBy("term").agg(F.count("*").alias("freq")).where((F.col("freq") >= min_frequency) & (F.col("freq") <= n_docs * 2.0**-min_pmi))
    numbered = _ranked(often.withColumn("_by", F.struct(-F.col("freq"), F.col("term"))), "_by")
    numbered = checkpointed(numbered.select("term", "freq", (F.col("_rank") - 1).cast("int").alias("_no")))
    steps = sorted(((r["freq"], r["first"]) for r in numbered.groupBy("freq").agg(F.min("_no").alias("first")).collect()), key=lambda x: x[1])
    listed = sets.join(numbered.select("term", "_no"), "term").groupBy("_d").agg(F.array_sort(F.collect_set("_no")).alias("_t")).select("_t")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    dealt = _dealt(checkpointed(listed).coalesce(cores)).repartitionById(DEALT, F.col("share"))
    name = lambda c: numbered.select(F.col("_no").alias(f"_{c}"), F.col("term").alias(c))
    found = _best(dealt, steps, n_docs, min_pmi).withColumnsRenamed({"child": "_child", "parent": "_parent"})
    return found.join(name("child"), "_child").join(name("parent"), "_parent").groupBy("child").agg(F.min_by("npmi", "parent").alias("npmi"), F.min("parent").alias("parent")).select("child", "parent", "npmi")


def taxonomy_parents(pairs: DataFrame) -> DataFrame:
    """(child, parent, npmi): the partner of higher frequency (ties: the first of the two) in a child's
    first pair by falling npmi, then terms."""
    first_up = F.col("freq_a") >= F.col("freq_b")
    rows = pairs.select(
        F.when(first_up, F.col("term_b")).otherwise(F.col("term_a")).alias("child"),
        F.when(first_up, F.col("term_a")).otherwise(F.col("term_b")).alias("parent"),
        "npmi", "term_a", "term_b",
    )
    order = F.struct(-F.round("npmi", 9), F.col("term_a"), F.col("term_b"))
    return rows.groupBy("child").agg(F.min_by("parent", order).alias("parent"), F.min_by("npmi", order).alias("npmi"))


def counts_by(df: DataFrame, *columns: str, measure: Column | None = None) -> DataFrame:
    """Counts for each column's values and the grand total, by one aggregate with grouping sets; keys
    are (dimension, value)."""
    sets = [*[[c] for c in columns], []]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    amount = F.sum(measure) if measure is not None else F.lit(None).cast("double")
    out = grouped.agg(F.count("*").alias("n"), amount.alias("amount"), F.grouping_id().alias("_g"))
    full = (1 << len(columns)) - 1
    dimension, value = F.lit("total"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("_g") == full - (1 << (len(columns) - 1 - i))
        dimension, value = F.when(mine, F.lit(c)).otherwise(dimension), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n", "amount")
