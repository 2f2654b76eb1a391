import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components as C
from quarry.llm import jaccard_join as J
from tests.llm import helpers


def found(spark, docs):
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return {r.id: (r.n_shingles, r.component) for r in J.near_duplicates(rows).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_are_those_of_all_pairs(spark, seed):
    docs = helpers.family_docs(seed)
    assert found(spark, docs) == helpers.classes(docs)


def test_large_groups_with_a_common_part(spark):
    """Keys of many texts: a chain in which only neighbours link, and texts that share half of theirs."""
    rng = random.Random(9)
    vocab = helpers.vocabulary(400, rng)
    base = [rng.choice(vocab) for _ in range(120)]
    docs = []
    for i in range(40):
        base = list(base)
        base[(7 * i) % 120] = f"new{i}"
        docs.append((i, " ".join(base)))
    half = [rng.choice(vocab) for _ in range(60)]
    docs += [(100 + i, " ".join(half + [rng.choice(vocab) for _ in range(60)])) for i in range(40)]
    docs += [(200 + i, " ".join(half + [rng.choice(vocab) for _ in range(14)])) for i in range(30)]
    rng.shuffle(docs)
    assert found(spark, docs) == helpers.classes(docs)


@pytest.mark.parametrize("flush", [1500, 5000])
def test_keys_that_tasks_share(spark, monkeypatch, flush):
    """Groups that are split among many hands over of a task: members in different ones still meet."""
    monkeypatch.setattr(J, "CROWD", 2)
    monkeypatch.setattr(J, "FLUSH", flush)
    docs = helpers.family_docs(11, 150)
    assert found(spark, docs) == helpers.classes(docs)


def test_edges_of_the_threshold(spark):
    """24 shared of 32 is linked, 23 of 31 + 1 is not."""
    base = [f"w{i}" for i in range(28 + 4)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:28])), (3, " ".join([*base[:21], *[f"z{i}" for i in range(4)]]))]
    assert found(spark, docs) == helpers.classes(docs)


def test_odd_rows(spark):
    rows = spark.createDataFrame(helpers.ODD, "doc_id long, text string, lang string, source string").withColumn("id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = J.near_duplicates(rows).collect()
    assert len(got) == len(helpers.ODD)
    by = {r.id: (r.n_shingles, r.component) for r in got}
    assert by[None] == (0, None) and by[1] == by[2][:1] + (1,) and by[3] == (0, 3) and by[9][1] == 7
    assert J.near_duplicates(rows.limit(0)).count() == 0


def test_no_link_is_lost_by_keys():
    """Linked sets of any sizes share a key."""
    levels = J.Levels(3, 4)
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        a = rng.integers(1 << 62, size=n).astype(np.uint64)
        keep = int(rng.integers(int(0.75 * n), n + 1))
        b = np.concatenate([a[:keep], rng.integers(1 << 62, size=int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        shared, union = keep, n + len(b) - keep
        if 4 * shared < 3 * union or union == shared:
            continue
        assert union - shared <= levels.differ(n, len(b))
        text = np.repeat([0, 1], [n, len(b)])
        at, key = J._keys(text, np.concatenate([a, b]), levels)
        assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())
        x, y = (np.frombuffer(J._sketch(v), np.uint8) for v in (a, b))
        assert J._apart(x, y) <= union - shared


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 60)], [(5, 3), (3, 5), (9, 8), (8, 5), (20, 21)]])
def test_components(spark, links):
    up = {x: x for p in links for x in p}
    for a, b in links * len(up):
        up[a] = up[b] = min(up[a], up[b])
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if any(a != b and k in (a, b) for a, b in links)}


@pytest.mark.parametrize("seed", [1, 5])
def test_join_gives_every_link(spark, seed):
    """Every linked pair of different sets, by the least ids of equal ones, with its counts."""
    docs = helpers.family_docs(seed)
    docs += [(1000 + i, " ".join([f"w{j}" for j in range(60)] + [f"v{i}" for _ in range(1)])) for i in range(25)]  # a key of many linked texts
    rows, links = J.jaccard_links(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    sets = {}
    for i, t in sorted(docs):
        sets.setdefault(frozenset(helpers.shingle_set(t)), i)
    listed = sorted((i, s) for s, i in sets.items() if s)
    want = set()
    for x, (i, s) in enumerate(listed):
        for j, t in listed[x + 1 :]:
            if 4 * len(s & t) >= 3 * len(s | t):
                want.add((i, j, len(s & t), len(s | t)))
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    reps = {r.id: r.rep for r in rows.collect()}
    assert reps == {i: sets[s] if (s := frozenset(helpers.shingle_set(t))) else None for i, t in docs}


@pytest.mark.parametrize("words", [7, 11, 13, 15, 24, 44])
def test_unlike_short_texts_share_few_keys(words):
    """20,000 unlike sets: no key is one that many show, as an empty block's would be."""
    n = words - 4
    value = np.random.default_rng(words).integers(0, 1 << 64, 20_000 * n, dtype=np.uint64)
    _, key = J._keys(np.repeat(np.arange(20_000), n), value, J.Levels(3, 4))
    _, count = np.unique(key, return_counts=True)
    assert count.max() <= J.FEW


@pytest.mark.parametrize("gather", [3, 40, 2_000_000])
def test_components_of_random_links(spark, monkeypatch, gather):
    """Hubs, chains and clusters over many tasks, with forests cut anywhere."""
    monkeypatch.setattr(C, "GATHER", gather)
    rng = random.Random(gather)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(90)] + [(2000, 2001 + i) for i in range(50)]
    links += [(3000 + i, 3000 + rng.randrange(60)) for i in range(60)]
    rng.shuffle(links)
    up = {x: x for p in links for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = [tuple(r) for r in C.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()]
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert sorted(got) == sorted((x, top(x)) for x in linked)


def test_spanning_pairs_are_the_nearest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        one, two = rng.integers(n, size=(2, int(rng.integers(1, 150))))
        comp = rng.integers(n, size=n) * 7
        apart = rng.integers(5, size=len(one))
        some = comp[one] != comp[two]
        one, two, apart = one[some], two[some], apart[some]
        got = J._spanning(one, two, apart, comp.copy())
        up = {int(c): int(c) for c in comp}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        want = 0
        joined = 0
        for i in np.argsort(apart, kind="stable"):
            x, y = top(int(comp[one[i]])), top(int(comp[two[i]]))
            if x != y:
                up[x], want, joined = y, want + int(apart[i]), joined + 1
        assert len(set(got.tolist())) == len(got) == joined and apart[got].sum() == want


def test_borderline_copies_around_a_star(spark):
    """A hot group in which half of the pairs are just short of linked, and a key that unlike texts share."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(90)]
    docs = []
    for i in range(160):
        w = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 3])):
            w[at] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    rng.shuffle(docs)
    assert found(spark, docs) == helpers.classes(docs)
