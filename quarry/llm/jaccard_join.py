"""N-gram Jaccard join by parity sketches.

A text's set is that of its distinct k-word shingles. Texts of sizes a and b link when their
Jaccard similarity is at least t, which means that their symmetric difference has at most
(1 - t) / (1 + t) * (a + b) members.

* Sizes fall into bands. A band, and the border between two bands, is a *level* with one bound d on
  the difference of any two linked texts that it compares. A text takes part in its own band's
  level, and in a border's only if its partners can lie beyond it.
* At a level, every shingle flips one bit of a sketch of K blocks; a pair differing in at most d
  shingles differs in at most d bits, so at least K - d blocks hold the same shingles. Blocks are
  ranked by what they hold (most shingles first). Two texts that agree on K - d blocks share one
  within the first d + 1 of each (prefix principle), so only those become keys: no link is lost.
* Keys travel as packed arrays, dealt to buckets by hash; each bucket sorts its keys. A key of few
  texts gives its pairs; a key of many gives the links to its least text (a star).
* Candidate pairs are verified on whole texts, after the Hamming distance of whole-text parity
  sketches, a lower bound on the difference. Components follow. Texts around the same star that are
  still in different components are compared with one another, in square blocks of bounded size, by
  their sketches, then verified; all keys of a star together, so a pair comes up once for a star.
* Equal sets are joined by hash before all that, so copies are never compared with one another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._filters import bit_of, filter_size, id_bits, set_bits
from quarry.llm._words import SPACED, mix, shingles, slices, words
from quarry.llm.components import components, forest
from quarry.session import checkpointed, sized

#: Ratio of a band's ends; share of blocks beyond d + 1.
RATIO, SPARE = 1.6, 1.3
#: Fewest blocks of a sketch for a bound of 1, 2 and more: a set of few shingles then fills more blocks than
#: it shows, so that (but for a few in a hundred thousand) none that it shows is empty and alike for all.
LEAST_BLOCKS = (0, 128, 24, 16)
#: Keys gathered before they are dealt out; keys of a bucket; members of a key given as all pairs.
FLUSH, BUCKET, FEW = 400_000, 1_000_000, 8
#: Texts that share a key among those gathered before the key is dealt as its least text alone.
CROWD = 64
#: Fewest buckets. A pair comes up once for each bucket in which it shares a key, so with few buckets
#: the pairs made would depend on their number rather than on the input.
LEAST_BUCKETS = 128
#: Pairs, sets and members of a task, where there are enough for all cores.
EACH = 20_000
#: Pairs of texts whose shingles are held at a time.
VERIFY = 500


class Levels:
    """Bands of set sizes, and the bounds of each level, for similarity num/den."""

    def __init__(self, num: int, den: int, most: int = 1 << 40):
        self.num, self.den = num, den
        ends = [1]
        while ends[-1] <= most:
            ends.append(max(ends[-1] + 1, math.ceil(ends[-1] * max(RATIO, den / num))))
        self.ends = np.array(ends, dtype=np.int64)

    def differ(self, a, b):
        """The largest symmetric difference of linked sets of sizes a and b."""
        return (np.asarray(a) + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, level number, d, own d) for own bands, borders above and borders below: d bounds all
        pairs of a level, own d those of a set of this size."""
        band = np.searchsorted(self.ends, n, side="right") - 1
        low, high = self.ends[band], self.ends[band + 1]
        rows = np.arange(len(n))
        most = n * self.den // self.num  # the largest partner
        up = most >= high
        down = (n * self.num + self.den - 1) // self.den <= low - 1

        def border(end):
            return self.differ(end - 1, (end - 1) * self.den // self.num)

        return [
            (rows, 2 * band, self.differ(high - 1, high - 1), self.differ(n, np.minimum(most, high - 1))),
            (rows[up], 2 * band[up] + 1, border(high[up]), self.differ(n, most)[up]),
            (rows[down], 2 * band[down] - 1, border(low[down]), self.differ(n, low - 1)[down]),
        ]


def _blocks(d: np.ndarray) -> np.ndarray:
    """The number of blocks of the sketches of a level."""
    return np.maximum(np.ceil(SPARE * d).astype(np.int64) + 2, np.array(LEAST_BLOCKS)[np.minimum(d, len(LEAST_BLOCKS) - 1)])


def _keys(text: np.ndarray, value: np.ndarray, levels: Levels) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all blocks that the texts' sets have to show."""
    if not len(text):
        return text[:0], value[:0]
    ids, first, n = np.unique(text, return_index=True, return_counts=True)
    out_text, out_key = [], []
    for rows, level, d, own in levels.of(n):
        some = own > 0  # else only equal sets link
        rows, level, d, own = rows[some], level[some], d[some], own[some]
        if not len(rows):
            continue
        blocks = _blocks(d)
        base = np.concatenate([[0], np.cumsum(blocks)])
        size = n[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[rows], size)
        with np.errstate(over="ignore"):
            # a shingle's block by the upper half of its hash; its bit there is the whole hash
            block = (value[member] >> np.uint64(32)) * blocks[owner].astype(np.uint64) >> np.uint64(32)
            cell = base[owner] + block.astype(np.int64)
            held = np.zeros(base[-1], np.uint64)
            np.bitwise_xor.at(held, cell, mix(value[member]))
            count = np.bincount(cell, minlength=base[-1])
            of = np.repeat(np.arange(len(rows)), blocks)
            place = (np.arange(base[-1]) - base[of]).astype(np.uint64)
            salt = (level[of].astype(np.uint64) << np.uint64(40)) | place
            key = mix(held ^ mix(salt + (count.astype(np.uint64) << np.uint64(52))))
        rank = (of.astype(np.uint64) << np.uint64(40)) | (
            (255 - np.minimum(count, 255)).astype(np.uint64) << np.uint64(32)
        )
        order = np.argsort(rank | (key >> np.uint64(32)))
        shown = np.arange(base[-1]) - base[of[order]] <= own[of[order]]
        out_text.append(ids[rows[of[order][shown]]])
        out_key.append(key[order][shown])
    if not out_text:
        return text[:0], value[:0]
    return np.concatenate(out_text), np.concatenate(out_key)


def _set_marks(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the size of its set and a hash of it (0 for an empty set)."""
    size = np.bincount(text, minlength=n)
    mark = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(mark, text, mix(value ^ np.uint64(0x51)))
    return size, mark


def _sketch(value: np.ndarray) -> bytes:
    """A parity sketch of a set: a power of two of bits, at least four for each member, so that a longer
    sketch folds to a shorter one and few members hide one another."""
    bits = 64 << max(0, int(4 * len(value) - 1).bit_length() - 6)
    odd = np.bincount((value % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _nodes(size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """What stands for a set in joins: a hash of its size and members; -1 for an empty set."""
    with np.errstate(over="ignore"):
        found = (mix(mark + size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    return np.where(size > 0, found, -1)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, text_hash, n_shingles, node, sketch): of each row, Spark's hash of its text, size, hash and
    parity sketch of its set; the sketch is null where the task has shown that of an equal set. Null and
    wordless texts have size 0 and node -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, buf, offs in slices(batch.column(2)):
                text, value = shingles(words(buf, offs, SPACED), k)
                size, mark = _set_marks(text, value, hi - lo)
                node = _nodes(size, mark)
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                made = []
                for x, y, own in zip(cuts, cuts[1:], node.tolist(), strict=False):
                    made.append(None if own in seen else _sketch(value[x:y]))
                    seen.add(own)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(size, pa.int64()), pa.array(node), pa.array(made, pa.binary())],
                    names=["id", "text_hash", "n_shingles", "node", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, n_shingles long, node long, sketch binary")


#: What a packed row holds: (text, key); the same for the least text of a key that many texts of a task
#: share; (least text, text) of such a key.
KEYS, HOT_KEYS, STARS = range(3)
#: What a bucket tells: (a, b) to be compared; (star, text) around it; (upper star, star) of one key.
PAIR, AROUND, UPPER = range(3)


def _part(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by its leading bits."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(kind: int, ids: np.ndarray, keys: np.ndarray, part: np.ndarray) -> list[tuple]:
    """(part, kind, ids, keys) of each bucket that has any."""
    order = np.argsort(part, kind="stable")
    part, ids, keys = part[order], ids[order], keys[order]
    cuts = np.concatenate([np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]])
    return [(int(part[a]), kind, ids[a:b].tobytes(), keys[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _deal(docs: DataFrame, id_col: str, text_col: str, k: int, levels: Levels, buckets: int) -> DataFrame:
    """Packed keys by bucket. Of equal sets within a task only the first shows its keys, so copies
    cost a key for each task at most; a key that many texts of a task share costs its bucket one, too,
    so a bucket does not grow with a hot group but with the number of tasks that hold part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(keys)
            ids, keys = ids[order], keys[order]
            cuts = np.concatenate([np.flatnonzero(np.diff(keys, prepend=~keys[:1])), [len(keys)]])
            size = np.diff(cuts)
            rare = np.repeat(size <= CROWD, size)
            rows = _packed(KEYS, ids[rare], keys[rare], _part(keys[rare], buckets))
            # a key of many texts goes on as its least one, around which the others are
            hot = [(keys[lo], np.unique(ids[lo:hi])) for lo, hi in zip(cuts[:-1][size > CROWD], cuts[1:][size > CROWD], strict=True)]
            if hot:
                key, least = np.array([k for k, _ in hot], np.uint64), np.array([m[0] for _, m in hot])
                star = np.unique(np.stack([np.repeat(least, [len(m) for _, m in hot]), np.concatenate([m for _, m in hot])], 1), axis=0)
                rows += _packed(HOT_KEYS, least, key, _part(key, buckets))
                rows += _packed(STARS, star[:, 0], star[:, 1], _part(mix(star[:, 1].astype(np.uint64)), buckets))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int8(), pa.binary(), pa.binary()), strict=True)], names=["part", "kind", "ids", "keys"])

        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            for lo, hi, buf, offs in slices(batch.column(1)):
                text, value = shingles(words(buf, offs, SPACED), k)
                size, mark = _set_marks(text, value, hi - lo)
                node = _nodes(size, mark)
                fresh = np.zeros(hi - lo, bool)
                for i in np.flatnonzero((size > 0) & known[lo:hi]):
                    if (it := int(node[i])) not in seen:
                        seen.add(it)
                        fresh[i] = True
                use = fresh[text]
                text, key = _keys(text[use], value[use], levels)
                if len(text):
                    held.append((node[text], key))
                    total += len(text)
                if total >= FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "part int, kind byte, ids binary, keys binary")


def _meet(table: pa.Table) -> pa.Table:
    """What a bucket's keys tell, as (kind, a, b). A key of few texts gives its pairs, one of more the least
    text as a star with all others around it. Where some task held many texts of a key, the stars of
    tasks are under the least of them, so all texts of the key can be found around that."""
    kinds = table["kind"].to_numpy()

    def of(kind: int, column: str, dtype=np.int64) -> np.ndarray:
        own = [np.frombuffer(x.as_buffer(), dtype) for x in table[column].filter(pa.array(kinds == kind))]
        return np.concatenate(own) if own else np.zeros(0, dtype)

    own = np.concatenate([of(KEYS, "ids"), of(HOT_KEYS, "ids")])
    key = np.concatenate([of(KEYS, "keys", np.uint64), of(HOT_KEYS, "keys", np.uint64)])
    shared = np.arange(len(own)) >= len(own) - len(of(HOT_KEYS, "ids"))
    stars = np.stack([of(STARS, "ids"), of(STARS, "keys")], 1)
    pairs, around, upper = [stars], [stars], [np.zeros((0, 2), np.int64)]
    order = np.argsort(key)
    own, key, shared = own[order], key[order], shared[order]
    cuts = np.concatenate([np.flatnonzero(np.diff(key, prepend=~key[:1])), [len(key)]])
    size = np.diff(cuts)
    some = np.logical_or.reduceat(shared, cuts[:-1]) if len(own) else np.zeros(0, bool)
    for m in range(2, FEW + 1):
        at = cuts[:-1][(size == m) & ~some]
        if len(at):
            members = np.sort(own[at[:, None] + np.arange(m)], axis=1)
            i, j = np.triu_indices(m, 1)
            pairs.append(np.stack([members[:, i].ravel(), members[:, j].ravel()], 1))
    large = (size > FEW) | some & (size > 1)
    for lo, hi in zip(cuts[:-1][large], cuts[1:][large], strict=True):
        members = np.unique(own[lo:hi])
        star = np.stack([np.full(len(members), members[0]), members], 1)
        pairs.append(star)
        around.append(star)
        held = np.unique(own[lo:hi][shared[lo:hi]])
        upper.append(np.stack([np.full(len(held), members[0]), held], 1)[held != members[0]])
    told = [np.unique(np.concatenate(x), axis=0) for x in (pairs, around, upper)]
    told[PAIR] = told[PAIR][told[PAIR][:, 0] != told[PAIR][:, 1]]
    both = np.concatenate(told)
    return pa.table({"kind": pa.array(np.repeat([PAIR, AROUND, UPPER], [len(x) for x in told]), pa.int8()), "a": both[:, 0], "b": both[:, 1]})


def _texts(docs: DataFrame, wanted: DataFrame, sets: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, text) of the sets that wanted (id, node) names, one row for each. A bit filter over ids, of a
    size that grows with the number of sets up to MOST_BITS, keeps most other texts from being read
    into shingles and shuffled; the join is exact."""
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(wanted, "id", size := filter_size(sets)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null").select(bit_of("id", size).alias("bit"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(set_bits(bits.value, batch.column(0)))
            for lo, hi, buf, offs in slices(batch.column(1)):
                node = _nodes(*_set_marks(*shingles(words(buf, offs, SPACED), k), hi - lo))
                fresh = []
                for i, own in enumerate(node.tolist()):
                    if own >= 0 and own not in seen:
                        seen.add(own)
                        fresh.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(node[fresh]), batch.column(1).slice(lo, hi - lo).take(pa.array(fresh, pa.int64()))], names=["node", "text"])

    return rows.mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs (x, y, a, b) of nodes and ids, those whose sets of k-word shingles have Jaccard similarity
    >= num/den, with shared and union_size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, VERIFY) for whole in batches for at in range(0, whole.num_rows, VERIFY)):
            got = [[], []]
            for side in (0, 1):
                for lo, hi, buf, offs in slices(batch.column(4 + side)):
                    text, value = shingles(words(buf, offs, SPACED), k)
                    cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                    got[side] += [value[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*got, strict=True)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(*got, strict=True)], np.int64) - both
            good = pa.array((both * den >= union * num) & (union > 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both), pa.array(union)], names=["x", "y", "a", "b", "shared", "union_size"]).filter(good)

    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in "xy")
    joined = pairs.join(one, "x").join(two, "y").select("x", "y", "a", "b", "text_x", "text_y")
    return joined.mapInArrow(run, "x long, y long, a long, b long, shared long, union_size long")


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """The Hamming distance of two sketches, the longer one folded."""
    bits = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, bits), axis=0) if len(z) > bits else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _close(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes whose sizes and sketches don't rule a link out, with the ids a and b."""
    levels = Levels(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            good = np.minimum(n, m) * den >= np.maximum(n, m) * num
            most = levels.differ(n, m)
            for i in np.flatnonzero(good):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (6, 7))
                good[i] = _apart(x, y) <= most[i]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good))

    one, two = (sets.select(F.col("node").alias(c), F.col("rep").alias(i), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c, i in ("xa", "yb"))
    joined = pairs.join(one, "x").join(two, "y").select("x", "y", "a", "b", "nx", "ny", "sx", "sy")
    return joined.mapInArrow(run, "x long, y long, a long, b long")


def _spanning(one: np.ndarray, two: np.ndarray, apart: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the pairs (places one and two, of components comp) make a forest that connects all that the
    pairs connect, by the least distances; of ties the first."""
    order = np.argsort(apart, kind="stable")
    x, y = comp[one[order]], comp[two[order]]
    at, taken = np.arange(len(order)), []
    while len(at):
        # each component's nearest pair; then the components that these join are one
        _, first = np.unique(np.stack([x, y], 1), return_index=True)
        chosen = np.unique(first // 2)
        taken.append(at[chosen])
        node, least = forest(np.maximum(x[chosen], y[chosen]), np.minimum(x[chosen], y[chosen]))
        for z in (x, y):
            place = np.minimum(np.searchsorted(node, z), len(node) - 1)
            z[:] = np.where(node[place] == z, least[place], z)
        left = x != y
        x, y, at = x[left], y[left], at[left]
    return order[np.concatenate([np.zeros(0, np.int64), *taken]).astype(np.int64)]


#: Which pairs around stars are given: all, those of different components, or a forest of these.
EVERY, ACROSS, SPANNING = range(3)


def _around(members: DataFrame, sets: DataFrame, num: int, den: int, give: int, side: int = 4096) -> DataFrame:
    """Pairs (run, x, y, a, b) around a star whose sketches don't rule a link out. members: (run, node,
    component), run being the star. Its members are cut into parts of about `side` and each two parts
    meet in a group of their own, so no task holds them all; a member is dealt once for each part, so
    rows grow with the square of a run beyond `side`. A forest is one of each two parts."""
    levels = Levels(num, den)
    spread = members.groupBy("run").agg(F.count("*").alias("m"), F.min("component").alias("u"), F.max("component").alias("v"))
    spread = (spread.where("m > 1") if give == EVERY else spread.where("u <> v")).select("run", F.ceil(F.col("m") / side).cast("int").alias("parts"))
    own = members.join(spread, "run").join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "run", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "rep", "component", "n", "sketch"
    )

    def compare(table: pa.Table) -> pa.Table:
        part, ids, rep, comp, n = (table[c].to_numpy() for c in ("part", "node", "rep", "component", "n"))
        marks = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["sketch"]]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        size = np.array([len(x) for x in marks])
        right = np.flatnonzero(part == j)
        # texts of one sketch length by rising size of set: what can link is a run of them
        kinds = {s: (own := right[size[right] == s])[np.argsort(n[own], kind="stable")] for s in np.unique(size[right])}
        folded = {}
        for s, own in kinds.items():
            held = np.stack([marks[y] for y in own])
            for bits in {min(s, t) for t in np.unique(size)}:
                folded[s, bits] = np.bitwise_xor.reduce(held.reshape(len(own), -1, bits), axis=1).view(np.uint64)
        left, found, far = [], [], []
        for x in np.flatnonzero(part == i):
            for s, own in kinds.items():
                lo, hi = np.searchsorted(n[own], [-(-n[x] * num // den), n[x] * den // num + 1])
                if lo == hi:
                    continue
                some, bits = own[lo:hi], min(s, size[x])
                ok = np.ones(len(some), bool) if give == EVERY else comp[some] != comp[x]
                if i == j:
                    ok &= ids[some] > ids[x]
                some = some[ok]
                mine = np.bitwise_xor.reduce(marks[x].reshape(-1, bits), axis=0).view(np.uint64)
                apart = np.bitwise_count(folded[s, bits][lo:hi][ok] ^ mine).sum(axis=1, dtype=np.int32)
                ok = apart <= levels.differ(n[x], n[some])
                left.append(np.full(int(ok.sum()), x, np.int32))
                found.append(some[ok].astype(np.int32))
                far.append(apart[ok])
        one, two, apart = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (left, found, far))
        if give == SPANNING:
            chosen = _spanning(one, two, apart, comp)
            one, two = one[chosen], two[chosen]
        one, two = np.where(ids[one] < ids[two], one, two), np.where(ids[one] < ids[two], two, one)
        return pa.table({"run": pa.array(np.full(len(one), table["run"][0].as_py(), np.int64)), "x": ids[one], "y": ids[two], "a": rep[one], "b": rep[two]})

    return dealt.groupBy("run", "i", "j").applyInArrow(compare, "run long, x long, y long, a long, b long")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows is shingle_sets without sketches; sets has one row for each different set of rows
    with an id: (node, rep, n, sketch), rep being the least id."""
    made = checkpointed(shingle_sets(docs, id_col, text_col, k))
    sets = made.where("n_shingles > 0").groupBy("node").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")
    )
    return made.drop("sketch"), checkpointed(sized(sets.where("rep is not null"), made.count(), EACH))


def _joined(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of the nodes that links (x, y), and earlier components, connect."""
    links = links.select(F.col("x").alias("a"), F.col("y").alias("b"))
    return components(links if joined is None else joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def _links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """(links, joined): links (x, y, a, b, shared, union_size) of nodes x and y and their least ids, a row may
    repeat; joined are the components of some links, where it was found out.

    Keys of many texts give the links to their stars first. Of the texts around a star that are then
    still in different components, a forest of the nearest pairs is verified, and where one of these
    proves no link, all the other pairs that sketches don't rule out; with `every`, all pairs at once."""
    told = sets.agg(F.count("*").alias("m"), F.sum("n").alias("n")).first()
    buckets = max(LEAST_BUCKETS, min(1 << 20, int((told.n or 0) * 0.8 / BUCKET) + 1))
    dealt = _deal(docs, id_col, text_col, k, Levels(num, den), buckets)
    met = checkpointed(dealt.groupBy("part").applyInArrow(_meet, "kind byte, a long, b long"))
    kinds = {r.kind: r["count"] for r in met.groupBy("kind").count().collect()}
    pairs = met.where(F.col("kind") == PAIR).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()

    def checked(pairs: DataFrame, n: int) -> DataFrame:
        wanted = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id")))).alias("w")).select("w.id")
        return checkpointed(sized(_verified(pairs, _texts(docs, wanted, told.m, id_col, text_col, k), k, num, den), n, EACH))

    pairs = checkpointed(sized(_close(pairs, sets, num, den), kinds.get(PAIR, 0), EACH))
    links = checked(pairs, pairs.count())
    if not kinds.get(AROUND):
        return links, None
    runs = met.where(F.col("kind") == AROUND).select(F.col("a").alias("run"), F.col("b").alias("node"))
    if kinds.get(UPPER):
        upper = met.where(F.col("kind") == UPPER).select(F.col("a").alias("top"), F.col("b").alias("run")).distinct()
        runs = runs.union(runs.join(upper, "run").select("top", "node"))
    runs = runs.distinct()
    joined, new = None, links
    for give in [EVERY] if every else [SPANNING, ACROSS]:
        if give == EVERY:
            members = runs.withColumn("component", F.col("node"))
        else:
            joined = _joined(joined, new)
            members = runs.join(joined.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        members = checkpointed(sized(members, 2 * kinds[AROUND], EACH))
        found = checkpointed(sized(_around(members, sets, num, den, give), kinds[AROUND], EACH))
        pairs = found.select("x", "y", "a", "b").dropDuplicates(["x", "y"])
        n = pairs.count()
        if not n:
            break
        new = checked(pairs, n)
        links = links.unionByName(new)
        if new.count() == n:
            break  # what sketches let through is connected
        runs = members.join(found.join(new, ["x", "y"], "left_anti").select("run").distinct(), "run", "left_semi").select("run", "node")
    return links, joined


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of a similarity join of docs with itself.

    rows: one for each row of docs: (id, n_shingles, rep), rep being the least id with an equal set,
    null for an empty set. links: every verified link between two different sets, once, by their reps:
    (a, b, shared, union_size), a < b; copies are not expanded into pairs.

    Null ids keep their row, with a null rep; null or wordless texts have empty sets and no links; rows
    that repeat an id are compared by their own texts. threshold is a ratio (num, den).
    """
    rows, sets = _sets(docs, id_col, text_col, k)
    links, _ = _links(docs, sets, id_col, text_col, k, *threshold, every=True)
    rows = rows.join(sets.select("node", "rep"), "node", "left")
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "union_size")
    return rows.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep")), checkpointed(links.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """(id, text_hash, n_shingles, component) for every row of docs; component is the least id reachable by
    links, the row's own id if it has none, and null for a null id; text_hash is xxhash64 of the text.

    Links between texts that links join already are not looked for: those of jaccard_links connect
    the same. What holds for its rows holds here; a row without a set is in a class with none."""
    rows, sets = _sets(docs, id_col, text_col, k)
    links, joined = _links(docs, sets, id_col, text_col, k, *threshold, every=False)
    found = _joined(joined, links)
    of_set = sets.select("node", "rep").join(found.withColumnRenamed("id", "node"), "node")
    least = of_set.groupBy("component").agg(F.min("rep").alias("least"))
    of_set = sets.select("node", "rep").join(of_set.join(least, "component").select("node", "least"), "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "rep", "id"))
    return rows.join(of_set, "node", "left").select("id", "text_hash", "n_shingles", component.alias("component"))
