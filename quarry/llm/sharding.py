"""Shards of near equal bytes: a minimax contiguous partition of atomic groups.

Rows of equal text are a group, which no shard boundary splits. Groups stand in the order of a hash of
their text. A group that is at least as large as the mean of what is left takes a shard of its own, the
largest first; no partition could give that shard less. Over the others, the smallest capacity for which
a greedy walk fits them into the shards that are left is found by binary search, and the order is cut
there: no shard exceeds the capacity, and each cut is the one nearest to equal shares that keeps the rest
feasible.

The groups stay on the cluster. The driver sees sums over cells of the hash's range, 2^16 at first; the
greedy walk over cells gives bounds on where a cut can be, and only cells that a cut can fall into are
divided further, until every cut is between two groups. So the capacity is exact for any number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._columns import free
from quarry.session import checkpointed

SHARDS = 24
#: Bytes that each row counts besides its text.
ROW = 8
#: Bits of the hash in the first cells, and bits added each time a cell is divided.
FIRST, MORE = 16, 8
#: Parts of a shard in which slots are numbered, and copies of one row that are dealt out together.
BLOCKS, COPIES = 4096, 100_000


@dataclass
class Plan:
    """Which groups make which shard: giants[i] is shard i; the others follow, in the order of their
    hash, a new shard beginning at each of cuts."""

    shards: int
    total: int
    capacity: int
    giants: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)

    def shard_of(self, group: Column) -> Column:
        out = F.lit(len(self.giants))
        for cut in self.cuts:
            out = out + (group >= cut).cast("int")
        for i, own in enumerate(self.giants):
            out = F.when(group == own, i).otherwise(out)
        return out.cast("int")


def group_of(text: Column) -> Column:
    """The hash by which texts are grouped and ordered; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class _Cells:
    """Sums over cells of the order: each has `bits` leading bits of the hash in common."""

    def __init__(self, groups: DataFrame, first: int, more: int):
        self.groups, self.more = groups, more
        self.low, self.bits, self.size, self.most, self.n = self._read(first, groups)
        self._sum()

    def _read(self, bits: int, groups: DataFrame) -> tuple[np.ndarray, ...]:
        found = groups.groupBy(F.shiftright("group", 64 - bits).alias("cell")).agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count("*").alias("n")).toArrow()
        cell, size, most, n = (found[c].to_numpy() for c in ("cell", "size", "most", "n"))
        order = np.argsort(cell)
        return cell[order] << np.int64(64 - bits), np.full(len(cell), bits), size[order], most[order], n[order]

    def _sum(self) -> None:
        self.upto = np.concatenate([[0], np.cumsum(self.size)])
        self.total = int(self.upto[-1])

    def at(self, x: int) -> int:
        """The cell that x falls into: upto[at] <= x < upto[at + 1]."""
        return int(np.searchsorted(self.upto, x, side="right")) - 1

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest sum of first groups that is not above x."""
        j = self.at(x)
        if j >= len(self.size) or self.n[j] == 1 or x == self.upto[j]:
            return int(self.upto[j]), int(self.upto[j])
        return max(int(self.upto[j]), x - int(self.most[j]) + 1), x

    def exact(self, x: int, up: bool, open_: set[int]) -> int:
        """The largest sum of first groups not above x, or (up) the smallest not below; where it lies
        within a cell of several groups, that cell is added to open_ and the cell's edge returned."""
        x = min(max(x, 0), self.total)
        j = self.at(x)
        if x == self.upto[j]:
            return x
        if self.n[j] > 1:
            open_.add(j)
        return int(self.upto[j + 1] if up else self.upto[j])

    def divide(self, open_: set[int]) -> None:
        """Divides the coarsest of the cells, by ranges of the hash."""
        bits = min(int(self.bits[j]) for j in open_)
        chosen = sorted(j for j in open_ if self.bits[j] == bits)
        ranges, width = [], (1 << (64 - bits)) - 1
        for j in chosen:
            low, high = int(self.low[j]), int(self.low[j]) + width
            if ranges and ranges[-1][1] + 1 == low:
                ranges[-1][1] = high
            else:
                ranges.append([low, high])
        inside = F.lit(False)
        for low, high in ranges:
            inside |= F.col("group").between(low, high)
        fresh = self._read(min(64, bits + self.more), self.groups.where(inside))
        rest = np.setdiff1d(np.arange(len(self.low)), chosen)
        own = [np.concatenate([a[rest], b]) for a, b in zip((self.low, self.bits, self.size, self.most, self.n), fresh, strict=True)]
        order = np.argsort(own[0])
        self.low, self.bits, self.size, self.most, self.n = (a[order] for a in own)
        self._sum()


def _reach(cells: _Cells, capacity: int, shards: int) -> tuple[int, int]:
    """Bounds of how far a greedy walk of so many shards comes."""
    low = high = 0
    for _ in range(shards):
        low, high = cells.floor(min(cells.total, low + capacity))[0], cells.floor(min(cells.total, high + capacity))[1]
    return low, high


def _least(holds, low: int, high: int) -> int:
    """The smallest value for which `holds` is true; it holds at high."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _capacity(cells: _Cells, shards: int) -> int:
    """The smallest feasible capacity."""
    while True:
        floor = max(-(-cells.total // shards), int(cells.most.max()))
        surely = _least(lambda c: _reach(cells, c, shards)[0] >= cells.total, floor, cells.total)
        perhaps = _least(lambda c: _reach(cells, c, shards)[1] >= cells.total, floor, surely)
        if perhaps == surely:
            return surely
        open_, low, high = set(), 0, 0
        for _ in range(shards):
            low, high = min(cells.total, low + perhaps), min(cells.total, high + surely)
            open_ |= {j for j in range(cells.at(low), min(cells.at(high), len(cells.n) - 1) + 1) if cells.n[j] > 1}
            low, high = cells.floor(low)[0], cells.floor(high)[1]
        cells.divide(open_)


def _cut(cells: _Cells, capacity: int, shards: int) -> list[int]:
    """The hashes at which the second shard and those after it begin."""
    while True:
        open_: set[int] = set()
        least = [cells.total] * (shards + 1)  # where shard j may begin at the earliest, for the rest to fit
        for j in range(shards - 1, 0, -1):
            least[j] = cells.exact(least[j + 1] - capacity, True, open_)
        ends, at = [], 0
        for j in range(1, shards):
            target = at + -(-(cells.total - at) // (shards - j + 1))
            below, above = cells.exact(target, False, open_), cells.exact(target, True, open_)
            near = below if target - below <= above - target else above
            at = min(max(near, least[j]), cells.exact(at + capacity, False, open_))
            ends.append(at)
        if not open_:
            # shards that stay empty, behind the last group, have no cut
            return [int(cells.low[cells.at(x)]) for x in ends if x < cells.total]
        cells.divide(open_)


def plan(groups: DataFrame, shards: int = SHARDS, first: int = FIRST, more: int = MORE) -> Plan:
    """The partition of (group, size), a row for each group. The driver gets the largest `shards` groups
    and sums over cells. An empty table gives a plan that puts everything into shard 0."""
    largest = groups.orderBy(F.desc("size"), "group").limit(shards).collect()
    total = int(groups.agg(F.sum("size")).first()[0] or 0)
    made, left = Plan(shards, total, 0), total
    for r in largest:
        if len(made.giants) + 1 >= shards or r["size"] * (shards - len(made.giants)) < left:
            break
        made.giants.append(r["group"])
        made.capacity = max(made.capacity, r["size"])
        left -= r["size"]
    if left:
        cells = _Cells(groups.where(~F.col("group").isin(made.giants)), first, more)
        capacity = _capacity(cells, shards - len(made.giants))
        made.cuts = _cut(cells, capacity, shards - len(made.giants))
        made.capacity = max(made.capacity, capacity)
    return made


def _weighed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_of(text).alias("group"))


def _groups(rows: DataFrame) -> DataFrame:
    return checkpointed(rows.groupBy("group").agg(F.sum(F.col("size") * F.col("n")).alias("size")))


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> tuple[DataFrame, Plan]:
    """(id, size, text_crc32, shard, slot) of every row, and the plan; slots of a shard run from 0 without
    a gap.

    size is the text's bytes in UTF-8 and ROW more. Null texts count as empty and make one group with
    empty ones. Null ids stay; rows that repeat id and text each get a slot. An empty table gives no
    rows. Other columns of docs are not read. Texts are hashed where they are read and never shuffled. A
    shard's rows are dealt to blocks by a hash of id and text, numbered within a block, and blocks
    begin where the counts of those before end, so a group that holds a third of all rows is numbered by many
    tasks; rows that repeat are counted before they are dealt, and their copies made afterwards."""
    rows = _weighed(docs, id_col, text_col).groupBy("id", "size", "text_crc32", "group").agg(F.count("*").alias("n"))
    rows = checkpointed(rows)
    made = plan(_groups(rows), shards)
    placed = rows.select("*", made.shard_of(F.col("group")).alias("shard"), F.pmod(F.xxhash64("id", "group"), F.lit(BLOCKS)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before("shard").orderBy("block")), F.lit(0)).alias("start"))
    within = before("shard", "block").orderBy("group", "id")
    numbered = placed.withColumn("in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["shard", "block"])  # shards x BLOCKS rows at most
    numbered = numbered.withColumn("slot", F.col("start") + F.col("in"))
    if not rows.where(F.col("n") > COPIES).isEmpty():
        chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))).alias("chunk")
        numbered = numbered.select("*", chunk).repartition("id", "group", "chunk")
        numbered = numbered.withColumns({"slot": F.col("slot") + F.col("chunk") * COPIES, "n": F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES)})
    out = numbered.select("id", "size", "text_crc32", "shard", "slot", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"))
    return out.select("id", "size", "text_crc32", "shard", (F.col("slot") + F.col("copy")).alias("slot")), made


def sharded(docs: DataFrame, text_col: str = "text", shards: int = SHARDS) -> tuple[DataFrame, Plan]:
    """docs with a column shard (shard_, if docs has one), and the plan. The rows stay where they are: a
    row's shard follows from its text and the plan."""
    weighed = _weighed(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), "id", "text").withColumn("n", F.lit(1))
    made = plan(_groups(weighed), shards)
    return docs.withColumn(free("shard", docs.columns), made.shard_of(group_of(F.col(text_col)))), made


def write(docs: DataFrame, path: str, text_col: str = "text", shards: int = SHARDS, files: int = 1) -> Plan:
    """Writes docs as Parquet folders shard=0, shard=1, ..., each of so many files, to which rows are dealt
    evenly, whatever share of them one text has."""
    out, made = sharded(docs, text_col, shards)
    name = out.columns[-1]
    file = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    out.withColumn("_file", file).repartition(shards * files, name, "_file").drop("_file").write.partitionBy(name).parquet(path)
    return made
