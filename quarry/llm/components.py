"""Connected components of an undirected graph given by its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed, sized

#: Links that are taken into a forest at a time.
GATHER = 2_000_000
#: Links of a task, where there are enough for all cores.
EACH = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): every node of the links (u, v) but the least of its component, with that."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = place[: len(u)], place[len(u) :]
    top = np.arange(len(ids))
    while len(x):
        # of each root the least root that a link leads to; then all point at their roots again
        high, low = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(top, high, low)
        while True:
            up = top[top]
            if np.array_equal(up, top):
                break
            top = up
        x, y = top[x], top[y]
        apart = x != y
        x, y = x[apart], y[apart]
    child = np.flatnonzero(top != np.arange(len(ids)))
    return ids[child], ids[top[child]]


def _forests(edges: DataFrame) -> DataFrame:
    """The links (u, v, moved) of each task, GATHER or so at a time, as stars around least nodes; moved
    tells whether that changed any link, or any had been changed. Links of one u that follow one another
    are taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(u: np.ndarray, v: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
            node, least = forest(u, v)
            order = np.lexsort((v, u))
            same = len(node) == len(u) and np.array_equal(u[order], node) and np.array_equal(v[order], least)
            told = np.full(len(node), bool(moved.any()) or not same)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least), pa.array(told)], names=["u", "v", "moved"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            if sum(len(x[0]) for x in held) >= GATHER:
                u, v, moved = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(u != u[-1])[-1]) + 1 if (u != u[-1]).any() else 0
                held = [(u[cut:], v[cut:], moved[cut:])]
                if cut:
                    yield made(u[:cut], v[:cut], moved[:cut])
        if held:
            yield made(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return edges.mapInArrow(run, "u long, v long, moved boolean")


def _dealt(edges: DataFrame, rows: int) -> DataFrame:
    return checkpointed(_forests(sized(edges.repartition("u"), rows, EACH).sortWithinPartitions("u")))


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id reachable.

    Each task makes the links it has into stars around least nodes. A round points every node at its
    parent's least parent, deals links by their upper node, and makes each task's into stars again;
    it ends when no task changes anything and no star's centre has a parent. A task holds GATHER links at
    once, and a node has a link for each task at most; the join with a hub that has most of the links
    is split by adaptive execution. Rounds are checkpointed. Null ends and self links are
    ignored; an empty input gives an empty result. ids are integers.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(False).alias("moved"))
    edges = _dealt(_forests(edges), links.count())
    rows = edges.count()
    if not rows:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        parents = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("top"))
        jumped = edges.join(parents, "v", "left")
        # a node with two parents links them as well, so nothing comes apart
        jumped = jumped.select("u", F.coalesce("top", "v").alias("v"), F.col("top").isNotNull().alias("moved"))
        edges = _dealt(sized(jumped, rows, EACH), rows)
        if not edges.agg(F.max("moved")).first()[0]:
            break
    else:
        raise RuntimeError("components did not converge")
    own = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)
