import math
import random
from hashlib import sha256

import numpy as np
import pytest

from quarry.llm import centroids


def plain(rows, width, clusters, rounds, seed=2):
    """[(id, cluster, distance, cluster inertia, inertia, digest)] by comparing all pairs."""
    whole = [
        (i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    mark = lambda i: (i is None, sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    held = [v for _, v in sorted(whole, key=lambda r: mark(r[0]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(held))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in whole]
        for k in range(len(held)):
            if own := [v for (_, v), c in zip(whole, of, strict=True) if c == k]:
                held[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in whole]
    told = lambda n: n if n < 2**63 else None
    sums = {c: sum(d for _, d, k in found if k == c) if all(d < 2**63 for _, d, k in found if k == c) else None for _, _, c in found}
    total = None if None in sums.values() else sum(sums.values())
    return sorted(
        ((i, c, told(d), sums[c] if sums[c] is None else told(sums[c]), total if total is None else told(total), sha256(",".join(map(str, held[c])).encode()).hexdigest()) for i, d, c in found),
        key=repr,
    )


def rows_of(kind, seed=0, n=150, width=6):
    rng = random.Random(seed)
    if kind == "grid":  # many ties
        return [(i, [rng.randrange(-2, 3) / 256 for _ in range(width)]) for i in range(n)]
    if kind == "spread":
        return [(i, [rng.gauss(0, 1) * 10 ** rng.randrange(-2, 3) for _ in range(width)]) for i in range(n)]
    if kind == "huge":
        return [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 0, 0, 9, 30, 306]) for _ in range(width)]) for i in range(n)]
    odd = [(None, [0.5] * width), (None, [0.25] * width), (3, None), (4, []), (5, [0.1] * (width - 1)), (6, [None] + [0.1] * (width - 1)), (7, [float("nan")] * width), (8, [float("inf")] + [0.0] * (width - 1))]
    return odd + [(i % 9, [rng.random() for _ in range(width)]) for i in range(40)] + [(1, [0.5] * width)] * 3


@pytest.mark.parametrize("kind", ["grid", "spread", "huge", "odd"])
def test_clusters_are_those_of_all_pairs(spark, kind):
    rows = sorted(rows_of(kind), key=lambda r: [] if kind != "odd" else (r[0] is None, r[0] or 0, [str(math.floor(256 * x)) for x in r[1]] if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) else []))
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    out, found = centroids.clustered(vectors, width=6, clusters=5, rounds=3)
    assert out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows, 6, 5, 3)
    assert len(found["centroids"]) == 5 and len(found["measured"]) == 3


def test_few_vectors_and_none(spark):
    vectors = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9])], "vec_id long, embedding array<float>")
    out, found = centroids.clustered(vectors, width=2, clusters=5)
    assert sorted(r.distance for r in out.collect()) == [0, 0] and len(found["centroids"]) == 2
    none, found = centroids.clustered(vectors.limit(0), width=2, clusters=5)
    assert none.collect() == [] and found == {"centroids": [], "measured": []}


def test_most_centroids_are_ruled_out_by_their_bounds():
    rng = np.random.default_rng(5)
    values = rng.normal(0, 32, (500, 64)).round().astype(np.int64)
    held = centroids.Centroids(values[:40].tolist(), 64, 40)
    codes, step, coded, rest = centroids._compressed(values)
    screen = np.concatenate([step[:, None], (values**2).sum(axis=1)[:, None], coded, rest], axis=1)
    apart = ((values[:, None, :] - values[None, :40, :]) ** 2).sum(axis=2)
    bounds = held.bounds(codes, screen)
    squares = (values**2).sum(axis=1)
    assert (bounds <= apart).all() and (apart - bounds < 0.05 * (squares[:, None] + squares[None, :40])).all()
    cluster, distance, measured = held.nearest(values, codes, screen)
    assert (cluster == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    assert measured < 0.1 * apart.size
