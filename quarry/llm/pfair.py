"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash, are cut into blocks. In an ideal mix all sources flow at once,
each at a rate in proportion to its weight among those that have blocks left; t(i, j) is the time at
which j blocks of source i have flowed, one block of any source passing in a unit of time. Block j (from
1) is released at slot floor(t(i, j - 1)) and due by slot ceil(t(i, j)); for a source of share w that is
floor((j - 1) / w) and ceil(j / w) until some source runs out. Each slot takes, of the released blocks,
the one due earliest. As the ideal mix serves every block within its window, that meets every deadline, so
at any slot each source is less than one block away from its target.

Times follow from the weights themselves, without a period, and are exact: where a float is near a whole
number, fractions decide. The schedule is laid out on the driver, a slot for each block. It has at most
SLOTS slots (besides one for each source): beyond that, blocks get more rows. Rows find their slots by
a join with that table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._columns import free

#: Least rows of a block, most slots laid out, rows of a bucket when rows are numbered.
BLOCK, SLOTS, BUCKET = 64, 1 << 22, 2_000
#: A float this near a whole number is decided by fractions: more than float errors come to below 2^24 slots.
NEAR = 1e-5


class Flow:
    """The ideal mix of so many blocks of each source by weights."""

    def __init__(self, blocks: list[int], weights: list[float]):
        exact = [Fraction(w) for w in weights]
        self.blocks, self.weights = blocks, exact
        # sources end in the order of blocks / weight; before each end, what has flowed and what flows
        ends = sorted(range(len(blocks)), key=lambda i: (Fraction(blocks[i]) / exact[i], i))
        self.level, self.done, self.rate = [], [], []
        done, rate = 0, sum(exact)
        for i in ends:
            self.level.append(blocks[i] / exact[i])
            self.done.append(done)
            self.rate.append(rate)
            done, rate = done + blocks[i], rate - exact[i]
        self._levels, self._rates = np.array([float(x) for x in self.level]), np.array([float(x) for x in self.rate])
        self._done = np.array(self.done, float)

    def at(self, i: int, j: int) -> Fraction:
        """When j blocks of source i have flowed."""
        level = j / self.weights[i]
        phase = bisect_left(self.level, level)
        return self.done[phase] + self.rate[phase] * level

    def windows(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(release, due) of the blocks of source i."""
        level = np.arange(self.blocks[i] + 1) / float(self.weights[i])
        phase = np.minimum(np.searchsorted(self._levels, level), len(self.level) - 1)
        time = self._done[phase] + self._rates[phase] * level
        low, high = np.floor(time).astype(np.int64), np.ceil(time).astype(np.int64)
        near = np.flatnonzero(np.abs(time - np.rint(time)) < NEAR)
        # within a phase time is done + j * rate / weight; at the end of one, the phase is found exactly, too
        edge = np.minimum(np.abs(level - self._levels[phase]), np.abs(level - self._levels[np.maximum(phase - 1, 0)])) <= 1e-12 * level
        for j in near[edge[near]].tolist():
            exact = self.at(i, j)
            low[j], high[j] = exact.__floor__(), exact.__ceil__()
        near = near[~edge[near]]
        for k in np.unique(phase[near]).tolist():
            own, each = near[phase[near] == k], self.rate[k] / self.weights[i]
            kind = np.int64 if max(1, int(own[-1])) * each.numerator < 1 << 62 and each.denominator < 1 << 62 else object
            passed = own.astype(kind) * each.numerator
            low[own] = self.done[k] + (passed // each.denominator).astype(np.int64)
            high[own] = self.done[k] - (-passed // each.denominator).astype(np.int64)
        return low[:-1], high[1:]


def schedule(blocks: list[int], weights: list[float]) -> np.ndarray:
    """The source of each slot: of the released blocks the one due earliest, of ties that of the first
    source. blocks and weights are positive."""
    flow, n = Flow(blocks, weights), len(blocks)
    made = [flow.windows(i) for i in range(n)]
    if not made:
        return np.zeros(0, np.int64)
    release = np.concatenate([x[0] for x in made])
    mark = np.concatenate([x[1] * n + i for i, x in enumerate(made)])
    order = np.argsort(release, kind="stable")
    release, mark = release[order].tolist(), mark[order].tolist()
    out, waiting, at, total = [0] * len(mark), [], 0, len(mark)
    for slot in range(total):
        while at < total and release[at] <= slot:
            heapq.heappush(waiting, mark[at])
            at += 1
        out[slot] = heapq.heappop(waiting) % n
    return np.array(out, np.int64)


def _numbered(docs: DataFrame, source: str, id_col: str, seed: int) -> tuple[DataFrame, list[tuple]]:
    """(row, key, rank): the rows as structs with their place, from 0, within their source in the order
    of a hash; and (key, source, number of rows) of each source.

    A source's rows are dealt to buckets by the leading bits of their hash, as many as its size asks
    for; rows are ranked within a bucket, and buckets start where the counts of those before end. So
    no task sorts more than a bucket, whichever share of the rows a source has."""
    # a key without nulls, so that the window's partitioning serves the join with the buckets' starts
    key = F.concat(F.when(F.col(source).isNull(), "-").otherwise("+"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    sizes = [tuple(r) for r in docs.groupBy(key.alias("key"), F.col(source).alias("s")).agg(F.count("*").alias("n")).collect()]
    sizes.sort(key=lambda r: (r[1] is None, r[1]))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("mark"), F.col(id_col).alias("id"))
    wanted = docs.sparkSession.createDataFrame([(x, -(-n // BUCKET)) for x, _, n in sizes], "key string, buckets int")
    rows = rows.join(F.broadcast(wanted), "key")  # a row for each source
    share = F.shiftrightunsigned(F.col("mark"), 1) / F.lit(float(1 << 63))
    rows = rows.withColumn("bucket", F.least(F.floor(share * F.col("buckets")), F.col("buckets") - 1).cast("int"))
    counts = rows.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "bucket").orderBy("mark", "id")
    ranked = rows.withColumn("in", F.row_number().over(within) - 1)
    return ranked.join(starts, ["key", "bucket"]).select("row", "key", (F.col("start") + F.col("in")).alias("rank")), sizes


def mixed(
    docs: DataFrame, source: str = "source", id_col: str = "doc_id", weights: dict[str | None, float] | None = None,
    exponent: float = 0.5, block: int = BLOCK, slots: int = SLOTS, seed: int = 1,
) -> DataFrame:
    """docs with block (of its source, from 0), slot (from 0) and place (in the block, from 0): the order
    (slot, place) is the mix. Every row is kept; a source's last block may be short. A docs column of one
    of these names stays, and the added one gets an underscore behind its name.

    weights gives each source's target, positive; without it, a source's weight is its number of rows
    to the power `exponent`. A block has `block` rows, or as many more as keep the whole blocks at `slots`.
    A null source is a source of its own; rows that repeat, and null ids, each keep a place. An empty
    table gives no rows. The driver holds a number for each slot and each source."""
    ranked, sizes = _numbered(docs, source, id_col, seed)
    if weights is not None and (lacking := [x for _, x, _ in sizes if not weights.get(x, 0) > 0]):
        raise ValueError(f"no positive weight for {lacking[:5]}")
    block = max(block, -(-sum(n for *_, n in sizes) // slots))
    target = [float(weights[x]) if weights is not None else float(n) ** exponent for _, x, n in sizes]
    order = schedule([-(-n // block) for *_, n in sizes], target)
    spots = np.argsort(order, kind="stable")  # the slots of each source, source by source
    ends = np.cumsum(np.bincount(order, minlength=len(sizes)))
    listed = [spots[a:b].astype(np.int32) for a, b in zip(np.concatenate([[0], ends]), ends, strict=False)]
    table = pa.table({"key": pa.array([x for x, *_ in sizes], pa.string()), "spots": pa.array(listed, pa.list_(pa.int32()))})
    plan = docs.sparkSession.createDataFrame(table)  # at most `slots` numbers and two for each source
    names = dict(zip(("block", "slot", "place"), (free(x, docs.columns) for x in ("block", "slot", "place")), strict=True))
    whole = F.floor(F.col("rank") / block)
    placed = ranked.join(F.broadcast(plan), "key")
    return placed.select(
        "row.*", whole.alias(names["block"]), F.get("spots", whole.cast("int")).cast("long").alias(names["slot"]), (F.col("rank") % block).alias(names["place"])
    )
