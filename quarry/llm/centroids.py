"""Centroid clustering (k-means on integer vectors), screened by norms of segments.

Vectors become integers x, and each is compressed once: x = step * code + rest, with a byte a component.
With a centroid compressed likewise, the product of a vector and a centroid differs from that of their codes
by what the rests add, and by Cauchy-Schwarz that is at most the sum, over segments of components, of
products of norms: those of coded part and rest of the vector with those of rest and whole of the
centroid. So codes and precomputed norms give a lower bound of each distance. A vector is measured
exactly against the centroid of the least bound; then only centroids whose bound isn't above that
distance are measured, in integers. So every assignment is that of a comparison with all centroids.

Each round is a pass over the compressed table; what a task gathers is a sum for each cluster and
component. Sums, floors and distances are exact for components of any size: those that 64-bit arithmetic
can't hold go through Python's integers, and sums travel as digits to the base 10^18.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import checkpointed, shared_dir

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components of a segment, and the largest code.
SEGMENT, LARGEST = 8, 127
#: What floats may lose is taken off the bounds, as a share of the squared norms.
SLACK = 1e-6
_DIGITS = 10**18


def _limit(width: int, clusters: int) -> int:
    """Components up to this size give (distance, cluster) as one 64-bit number, and fit 32 bits."""
    return min(1 << 30, math.isqrt((1 << 62) // (width * max(1, clusters))) // 2)


def _segment_norms(values: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduceat(np.square(values, dtype=np.float64), np.arange(0, values.shape[1], SEGMENT), axis=1))


def _compressed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, step, norms of the coded segments, norms of the segments of the rests) of the rows."""
    step = np.maximum(1, np.abs(values).max(axis=1, initial=0)) / LARGEST
    codes = np.rint(values / step[:, None])
    coded = codes * step[:, None]
    return codes.astype(np.int8), step, _segment_norms(coded), _segment_norms(values - coded)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS) -> DataFrame:
    """(id, small, large, codes, screen) of the vectors that have `width` components, none null or
    non-finite: floor(scale * x) of each as an integer, in decimal (large) where 64 bits don't do; screen
    has the step, the squared norm and the norms of the segments, coded and rest."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.coalesce((F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where(whole)
    limit, kind = _limit(width, clusters), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            with np.errstate(over="ignore"):
                floors = np.floor(x * scale)
                fits = (np.abs(floors) <= limit).all(axis=1)
            small = np.where(fits[:, None], floors, 0).astype(np.int32)
            large = [None if ok else [str(math.floor(scale * v) if math.isfinite(scale * v) else scale * int(v)) for v in row] for ok, row in zip(fits.tolist(), x, strict=True)]
            listed = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind), mask=pa.array(~fits))
            codes, step, coded, rest = _compressed(small)
            screen = np.concatenate([step[:, None], np.square(small, dtype=np.float64).sum(axis=1)[:, None], coded, rest], axis=1)
            made = [listed(small, pa.int32()), pa.array(large, pa.list_(pa.string())), listed(codes, pa.int8()), listed(screen, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "small", "large", "codes", "screen"])

    path = f"{shared_dir(vectors.sparkSession)}/vectors-{uuid.uuid4().hex}"
    rows.mapInArrow(run, f"id {kind}, small array<int>, large array<string>, codes array<tinyint>, screen array<double>").write.parquet(path)
    return vectors.sparkSession.read.parquet(path)


class Centroids:
    """Centroids as Python integers, and those that 64-bit arithmetic holds as arrays."""

    def __init__(self, values: list[list[int]], width: int, clusters: int):
        self.values, self.width, self.limit = values, width, _limit(width, clusters)
        inside = [i for i, c in enumerate(values) if all(abs(x) <= self.limit for x in c)]
        self.inside, self.outside = np.array(inside, np.int64), [i for i in range(len(values)) if i not in set(inside)]
        self.small = np.array([values[i] for i in inside], np.int64).reshape(len(inside), width)
        # codes are multiplied as floats, which hold sums of their products exactly
        self.float = np.float32 if width * LARGEST**2 < 1 << 24 else np.float64
        codes, self.step, _, self.rest = _compressed(self.small)
        self.codes, self.whole = codes.astype(self.float), _segment_norms(self.small)
        self.square = np.square(self.small, dtype=np.float64).sum(axis=1)

    def bounds(self, codes: np.ndarray, screen: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances of rows and centroids."""
        step, square, norms = screen[:, 0], screen[:, 1], screen[:, 2:]
        product = (codes.astype(self.float) @ self.codes.T) * step[:, None] * self.step[None, :]
        product += norms @ np.concatenate([self.rest, self.whole], axis=1).T
        whole = square[:, None] + self.square[None, :]
        return whole * (1 - SLACK) - 2 * product - 1

    def nearest(self, small: np.ndarray, codes: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, distance) of rows that 64 bits hold by the centroids that they hold, and how many
        distances were measured."""
        n, k = len(small), len(self.inside)
        bound = self.bounds(codes, screen)
        first = bound.argmin(axis=1)

        def measured(row: np.ndarray, c: np.ndarray) -> np.ndarray:
            apart = small[row] - self.small[c]
            return np.einsum("ij,ij->i", apart, apart) * k + c

        best = measured(np.arange(n), first)
        open_ = bound <= (best // k)[:, None]
        open_[np.arange(n), first] = False
        row, c = np.nonzero(open_)
        for a in range(0, len(row), 1 << 16):
            np.minimum.at(best, row[a : a + (1 << 16)], measured(row[a : a + (1 << 16)], c[a : a + (1 << 16)]))
        return self.inside[best % k], best // k, n + len(row)

    def nearest_exactly(self, value: list[int], among: list[int]) -> tuple[int, int]:
        """(distance, cluster) of one vector by Python's integers."""
        return min((sum((x - y) ** 2 for x, y in zip(value, self.values[i], strict=True)), i) for i in among)

    def assigned(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, dict[int, list[int]]]:
        """(cluster, distance) of the rows of a batch of prepared vectors, distances being Python integers
        where 64 bits don't hold them; the number of distances that were measured; the rows' values,
        and those of rows that don't fit by their place."""
        n = batch.num_rows
        fits = batch.column("small").is_valid().to_numpy(zero_copy_only=False)
        take = pa.array(np.flatnonzero(fits))
        rows = int(fits.sum())
        small = batch.column("small").take(take).flatten().to_numpy().astype(np.int64).reshape(rows, self.width)
        codes = batch.column("codes").take(take).flatten().to_numpy().reshape(rows, self.width)
        screen = batch.column("screen").take(take).flatten().to_numpy().reshape(rows, -1)
        large = {i: [int(x) for x in batch.column("large")[i].as_py()] for i in np.flatnonzero(~fits).tolist()}
        cluster, distance, count = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        if rows and len(self.inside):
            cluster[fits], distance[fits], count = self.nearest(small, codes, screen)
        if large or (self.outside and rows):
            distance = distance.astype(object)
            for i, v in zip(np.flatnonzero(fits).tolist(), small.tolist(), strict=True) if self.outside else ():
                near = self.nearest_exactly(v, self.outside)
                distance[i], cluster[i] = min((distance[i], cluster[i]), near) if len(self.inside) else near
            for i, v in large.items():
                distance[i], cluster[i] = self.nearest_exactly(v, range(len(self.values)))
            count += len(large) * len(self.values) + rows * len(self.outside)
        return cluster, distance, count, small, large


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) to the base 10^18, with the value's sign."""
    sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        rest, digit = divmod(rest, _DIGITS)
        if digit:
            yield place, sign * digit
        place += 1


def _gathered(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by (cluster, component) of the digits that tasks have gathered."""
    total = parts.groupBy("cluster", "part", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit")).collect()
    out: dict[tuple[int, int], int] = {}
    for cluster, part, place, digit in total:
        out[cluster, part] = out.get((cluster, part), 0) + int(digit) * _DIGITS**place
    return out


def _sums(rows: DataFrame, centroids: Centroids) -> dict[tuple[int, int], int]:
    """Sums of the components of each cluster's vectors; component -1 counts vectors and -2 the
    distances that were measured (of cluster -1)."""
    width, k = centroids.width, len(centroids.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            cluster, _, count, small, large = centroids.assigned(batch)
            fits = np.ones(len(cluster), bool)
            fits[list(large)] = False
            held = np.zeros((k, width), np.int64)  # a batch's rows are too few to pass 64 bits
            np.add.at(held, cluster[fits], small)
            n = np.bincount(cluster, minlength=k)
            for c in np.flatnonzero(n).tolist():
                for j, x in enumerate(held[c].tolist()):
                    total[c, j] = total.get((c, j), 0) + x
                total[c, -1] = total.get((c, -1), 0) + int(n[c])
            for i, v in large.items():
                for j, x in enumerate(v):
                    total[cluster[i], j] = total.get((cluster[i], j), 0) + x
            total[-1, -2] = total.get((-1, -2), 0) + count
        made = [(c, j, *d) for (c, j), x in total.items() for d in _digits(x)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "part", "place", "digit"])

    return _gathered(rows.mapInArrow(run, "cluster int, part int, place int, digit long"))


def started(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest lowercase-hex SHA-256 of "seed:id"; rows that repeat an id go by
    their components. Vectors without an id come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(mark.alias("mark"), F.coalesce(F.col("small").cast("array<string>"), F.col("large")).alias("v"))
    return [[int(x) for x in r.v] for r in first.orderBy(F.asc_nulls_last("mark"), "v").limit(clusters).collect()]


def _drop(rows: DataFrame) -> None:
    """Removes the files that a frame of this module was read from."""
    for file in rows.inputFiles()[:1]:
        path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _long(value: int) -> int | None:
    return value if -(1 << 63) <= value < 1 << 63 else None


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, dict]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that has `width`
    components, none null or non-finite; and what was found: the centroids, and for each round how
    many distances were measured of how many (vector, centroid) pairs.

    Centroids start as the vectors with the smallest hashes of their ids, fewer if there are fewer
    vectors. Each round assigns every vector to the nearest centroid (squared distance; of ties the
    first) and puts every centroid that has vectors at the componentwise floor of their mean; then
    vectors are assigned once more. Other vectors, null ones included, are left out. Null ids stay, and
    never start a centroid before others; rows that repeat an id are vectors of their own. An empty
    table gives no rows. Distances and sums of them that pass 64 bits are null. Other columns are not
    read. Driver and tasks hold the centroids; a task gathers a sum for each cluster and component,
    whatever share of the vectors a cluster has."""
    rows = prepared(vectors, id_col, vector_col, width, scale, clusters)
    kind = rows.schema["id"].dataType.simpleString()
    held, measured = Centroids(started(rows, clusters, seed), width, clusters), []
    for _ in range(rounds if held.values else 0):
        sums = _sums(rows, held)
        moved = [[sums.get((c, j), 0) // sums[c, -1] for j in range(width)] if (c, -1) in sums else own for c, own in enumerate(held.values)]
        measured.append((sums[-1, -2], len(held.values) * sum(n for (_, j), n in sums.items() if j == -1)))
        held = Centroids(moved, width, clusters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _, _, large = held.assigned(batch)
            exact = {i: int(x) for i, x in enumerate(distance.tolist()) if _long(x) is None} if distance.dtype == object else {}
            told = pa.array([_long(x) for x in distance.tolist()] if exact or large else distance.astype(np.int64), pa.int64())
            passed = pa.array([str(exact[i]) if i in exact else None for i in range(len(cluster))], pa.string()) if exact else pa.nulls(len(cluster), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), told, passed], names=["id", "cluster", "distance", "passed"])

    assigned = checkpointed(rows.mapInArrow(run, f"id {kind}, cluster int, distance long, passed string"))
    inertia, beyond = {}, set()
    for c, total, passed in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")), F.count("passed")).collect():
        inertia[c] = int(total or 0)
        beyond |= {c} if passed else set()
    whole = None if beyond else _long(sum(inertia.values()))
    told = [(c, None if c in beyond else _long(n), whole, sha256(",".join(map(str, held.values[c])).encode()).hexdigest()) for c, n in inertia.items()]
    by = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.drop("passed").join(F.broadcast(by), "cluster")  # a row for each cluster
    _drop(rows)
    return out.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), {"centroids": held.values, "measured": measured}
