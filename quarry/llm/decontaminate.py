"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit verification.

A CGK walk over a sequence of words writes one word at each step and moves on by the random bit
that the step's hash gives that word; two sequences of small edit distance write outputs of small
Hamming distance. Sampling a few steps of the output therefore gives a locality-sensitive key.

Items fall into bands of length; a walk has as many steps as an item of its band covers. Each
repetition starts its walks at an anchor, the longest word near a place of its own in the item
(forwards in the first half, backwards in the second), and samples the first step and a few others.
A window of a text is a place whose word is an anchor of some item; if its sampled output equals the
item's, the whole item is aligned with the text around it and the exact edit distance decides.
Repetitions go on until the share of found items, measured on items that bear the tolerated number of
random edits, reaches the target recall. Items that tolerate no edit, those of fewer than five words
among them, are searched for exactly, by the hash of all their words.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._words import PLAIN, mix, seeded, slices, words

#: Least number of words of an item of each band (shorter items are searched for exactly).
BANDS = (5, 8, 16, 32, 64, 128)
#: Sampled steps, the first included; items of one pass over the texts; items of a band that recall is
#: measured on; repetitions after which a recall that is still below its target is an error.
SAMPLED, BLOCK, TRIES, GIVE_UP = 4, 20_000, 128, 1_024


def _bits(word: np.ndarray, rep: int, step: int) -> np.ndarray:
    return mix(word ^ np.uint64(0x1000 * rep + (step >> 6) + 1)) >> np.uint64(step & 63) & np.uint64(1)


def _steps(band: int, rep: int) -> np.ndarray:
    """The sampled steps, ascending, without step 0."""
    reach = max(2, int(0.8 * BANDS[band]))
    ranked = np.argsort(seeded(reach - 1, 7919 * band + rep)) + 1
    return np.sort(ranked[: SAMPLED - 1])


def _walk(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, rep: int, band: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of the walk from each place, and whether it stays within [first, last)."""
    place, inside = at.copy(), np.ones(len(at), bool)
    key = mix(hashes[at] ^ np.uint64(rep + 1))
    step = 0
    for sampled in _steps(band, rep):
        while step < sampled:
            place = place + way * _bits(hashes[place], rep, step).astype(np.int64)
            inside &= (place >= first) & (place < last)
            place = np.clip(place, first, last - 1)
            step += 1
        key = mix(key ^ hashes[place])
    return key, inside


@dataclass
class Index:
    """Keys of the items by (band, repetition)."""

    items: list[np.ndarray]
    ids: pa.Array
    edits: np.ndarray
    anchors: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    reps: dict[int, int] = field(default_factory=dict)
    recall: dict[int, float] = field(default_factory=dict)  # measured, by band
    exact: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: keys, items


def _whole(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    key = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(seeded(n, 31)):
            key += hashes[j : j + len(key)] * (factor | np.uint64(1))
    return mix(key)


def _way(rep: int) -> int:
    return 1 if rep % 2 == 0 else -1


def _anchor(lengths: np.ndarray, rep: int) -> int:
    """The longest word near the repetition's place in the item."""
    n = len(lengths)
    share = (seeded(1, 104729 + rep)[0] >> np.uint64(40)) / float(1 << 24) * 0.5
    centre = int(share * n) if _way(rep) > 0 else n - 1 - int(share * n)
    lo, hi = max(0, centre - 2), min(n, centre + 3)
    return lo + int(np.argmax(lengths[lo:hi]))


def build(ids: list[int | None], texts: list[str | None], tolerance: float, recall: float) -> Index:
    found = words(*_joined(texts), lexer=PLAIN)
    cuts, lengths = found.first, found.end - found.start
    items = [found.hash[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    index = Index(items, pa.array(ids, pa.int64()), np.array([int(tolerance * len(x)) for x in items], np.int64))
    exact: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        if len(item) and (not index.edits[i] or len(item) < BANDS[0]):
            exact.setdefault(len(item), []).append(i)
    for n, own in exact.items():
        key = np.concatenate([_whole(items[i], n) for i in own])
        order = np.argsort(key, kind="stable")
        index.exact[n] = (key[order], np.array(own)[order])
    for band, least in enumerate(BANDS):
        most = BANDS[band + 1] if band + 1 < len(BANDS) else 1 << 40
        own = [i for i, x in enumerate(items) if least <= len(x) < most and index.edits[i]]
        if not own:
            continue
        tries = _edited([items[i] for i in own[:: max(1, len(own) // TRIES)]], tolerance, band)
        hit, rep = np.zeros(len(tries), bool), -1
        while hit.mean() < recall or rep < 7:
            rep += 1
            if rep == GIVE_UP:
                raise RuntimeError(f"recall {hit.mean():.3f} after {rep} repetitions, for items of {least} words or more")
            way, places = _way(rep), {i: _anchor(lengths[cuts[i] : cuts[i + 1]], rep) for i in own}
            at = np.array([cuts[i] + places[i] for i in own])
            first, last = cuts[own], cuts[np.array(own) + 1]
            key, inside = _walk(found.hash, first, last, at, rep, band, way)
            order = np.argsort(key[inside], kind="stable")
            index.keys[band, rep] = (key[inside][order], np.array(own)[inside][order], (at - first)[inside][order])
            index.anchors[band, rep] = np.unique(found.hash[at[inside]])
            index.reps[band] = rep + 1
            for t, (source, edited) in enumerate(tries):
                if not hit[t]:
                    spots = np.flatnonzero(np.isin(edited, index.anchors[band, rep]))
                    if len(spots):
                        tried, _ = _walk(edited, np.zeros(len(spots), np.int64), np.full(len(spots), len(edited)), spots, rep, band, way)
                        own_key = key[[k for k, i in enumerate(own) if items[i] is source]]
                        hit[t] = bool(np.isin(tried, own_key).any())
        index.recall[band] = float(hit.mean())
    return index


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    held = [(x or "").encode() for x in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
    return np.frombuffer(b"".join(held), np.uint8), offs


def _edited(items: list[np.ndarray], tolerance: float, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each item with the tolerated number of random words replaced, left out or put in, in the
    midst of foreign words."""
    rng = np.random.default_rng(seed)
    out = []
    for item in items:
        row = list(item)
        for _ in range(int(tolerance * len(item))):
            at, kind, new = int(rng.integers(len(row))), int(rng.integers(3)), np.uint64(rng.integers(1 << 62))
            row[at : at + (kind != 1)] = [] if kind == 2 and len(row) > 1 else [new]
        pad = list(rng.integers(1 << 62, size=2 * len(item)).astype(np.uint64))
        out.append((item, np.array(pad[: len(item)] + row + pad[len(item) :], np.uint64)))
    return out


def distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(edits, end): the least edit distance, in words, of the item to any run of the text, and where
    the first such run ends. Bit-parallel dynamic programming over whole words."""
    m = len(item)
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text.tolist()):
        same = where.get(w, 0)
        cross = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(cross | up))
        minus = up & cross
        score += bool(plus & top) - bool(minus & top)
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~((same | down) | plus))
        down = plus & (same | down)
        if score < best:
            best, end = score, j + 1
    return best, end


def search(index: Index, found, n: int) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, edits) of each text and item that it holds, at its best place."""
    got: dict[tuple[int, int], tuple[int, int]] = {}
    if not len(found.hash):
        return []
    text = found.text_of()
    for n, (keys, items) in index.exact.items():
        run = _whole(found.hash, n)
        lo, hi = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
        at = np.flatnonzero(hi > lo)
        for k in at[text[at] == text[at + n - 1]].tolist():
            t, spot = int(text[k]), k - int(found.first[text[k]])
            for i in items[lo[k] : hi[k]].tolist():
                got.setdefault((t, i), (0, spot))
    tried: set[tuple[int, int]] = set()
    for band, reps in index.reps.items():
        known = np.unique(np.concatenate([index.anchors[band, r] for r in range(reps)]))
        if not len(known):
            continue
        near = known[np.minimum(np.searchsorted(known, found.hash), len(known) - 1)] == found.hash
        spots = np.flatnonzero(near)
        for rep in range(reps):
            anchors = index.anchors[band, rep]
            if not len(anchors) or not len(spots):
                continue
            own = found.hash[spots]
            at = spots[anchors[np.minimum(np.searchsorted(anchors, own), len(anchors) - 1)] == own]
            if not len(at):
                continue
            first, last = found.first[text[at]], found.first[text[at] + 1]
            key, inside = _walk(found.hash, first, last, at, rep, band, _way(rep))
            keys, item, offset = index.keys[band, rep]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for k in np.flatnonzero(inside & (hi > lo)):
                for e in range(lo[k], hi[k]):
                    i, begin = int(item[e]), int(at[k] - offset[e])
                    t = int(text[at[k]])
                    if (t, i) in got and got[t, i][0] == 0 or (i, begin) in tried:
                        continue
                    tried.add((i, begin))
                    slack = int(index.edits[i])
                    a = max(int(first[k]), begin - slack)
                    b = min(int(last[k]), begin + len(index.items[i]) + slack)
                    edits, end = distance(index.items[i], found.hash[a:b], slack)
                    if edits <= slack:
                        spot = (edits, max(a, a + end - len(index.items[i])) - int(first[k]))
                        got[t, i] = min(got.get((t, i), spot), spot)
    return [(t, i, spot, edits) for (t, i), (edits, spot) in sorted(got.items())]


def indices(items: DataFrame, item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = 0.99) -> Iterator[Index]:
    """The items (the query set) in blocks of 20,000, each with its keys and measured recall by band. Null
    texts are left out."""
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, math.ceil(listed.count() / BLOCK))
    for block in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        rows = sorted(part.collect(), key=lambda r: (r.i is None, r.i, r.t))
        yield build([r.i for r in rows], [r.t for r in rows], tolerance, recall)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", tolerance: float = 0.2, recall: float = 0.99,
) -> DataFrame:
    """(id, item_id, first_word, edits): every text and item that it holds within `tolerance` edits a
    word of the item, once, at the place of fewest edits (of ties the first found by word number).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. Null or empty texts
    hold nothing; null and wordless items are in none; null ids are kept, and rows that repeat an id
    each give their own. The items (the query set) are read in blocks of 20,000, one pass over the texts
    each, so what a task holds is bounded however many there are; no row of docs is shuffled.
    """
    spark, out = docs.sparkSession, None
    for index in indices(items, item_id, item_text, tolerance, recall):
        shared = spark.sparkContext.broadcast(pickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for batch in batches:
                for lo, hi, buf, offs in slices(batch.column(1)):
                    hits = search(index, words(buf, offs, PLAIN), hi - lo)
                    if hits:
                        t, i, spot, edits = (np.array(x, np.int64) for x in zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(t + lo)), index.ids.take(pa.array(i)), pa.array(spot), pa.array(edits)],
                            names=["id", "item_id", "first_word", "edits"],
                        )

        rows_of = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found = rows_of.mapInArrow(run, "id long, item_id long, first_word long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose text holds no item; their columns and order of columns stay. Each row is judged
    by its own text, in the pass that reads it, whatever its id."""
    spark, names, schema = docs.sparkSession, docs.columns, docs.schema
    for index in indices(items, **how):
        shared = spark.sparkContext.broadcast(pickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, hi, buf, offs in slices(batch.column(names.index(text_col))):
                    clean[[lo + t for t, *_ in search(index, words(buf, offs, PLAIN), hi - lo)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
