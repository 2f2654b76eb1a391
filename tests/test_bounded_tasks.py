"""What a task holds and hands on is bounded by parameters, not by the rows it reads."""

import numpy as np
import pandas as pd

from quarry.operators import chunking, search
from quarry.sources import sinks


def test_a_task_keeps_the_best_of_all_its_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 7)
    made = np.random.default_rng(1).integers(-2, 3, (100, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "i long, v array<double>").coalesce(1)
    handed = []
    monkeypatch.setattr(search, "pd", type("P", (), {"DataFrame": staticmethod(lambda x: handed.append(len(x["id"])) or pd.DataFrame(x))}))
    kept = {}
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, run, schema: kept.setdefault("out", spark.createDataFrame(pd.concat(run([self.toPandas().iloc[a : a + 20] for a in range(0, 100, 20)])), schema)))
    for metric in ("cosine", "euclidean"):
        kept.clear()
        got = search.nearest(rows, rows.where("i < 5"), "i", "v", k=3, metric=metric).collect()
        size = np.linalg.norm(made, axis=1)
        for q in range(5):
            if metric == "cosine":
                score = np.where(size * size[q] > 0, made @ made[q] / np.where(size * size[q] > 0, size * size[q], 1), 0.0).round(6)
                want = sorted(range(100), key=lambda i: (-score[i], -i))[:3]
            else:
                score = np.linalg.norm(made - made[q], axis=1).round(6)
                want = sorted(range(100), key=lambda i: (score[i], i))[:3]
            near = sorted((r.rank, r.score) for r in got if r.query_id == q)
            assert [s for _, s in near] == [score[i] for i in want]
    assert handed == [15, 15]  # three for each of five queries, of one task that got five batches


def test_chunks_are_cut_in_small_batches(spark):
    docs = spark.createDataFrame([("one two. " * 1000,)], "text string").crossJoin(spark.range(2000, numPartitions=1))
    assert chunking.chunked(docs, "id", "text", "topic").where("length(text) < 0").count() == 0
    sizes = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) * 9000 < 5_000_000


def test_texts_are_scored_where_they_are_read(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXTS_BLOCK", 3)
    monkeypatch.setattr(search, "CELLS", 40)
    words = [f"w{i}" for i in range(9)]
    make = np.random.default_rng(2)
    texts = [(i, " ".join(make.choice(words, make.integers(0, 12)))) for i in range(120)] + [(120, None)]
    items = [(i, " ".join(make.choice(words, 3))) for i in range(8)] + [(8, "none of these"), (9, None)]
    docs, asked = spark.createDataFrame(texts, "d long, x string"), spark.createDataFrame(items, "q long, y string")
    got = search.tfidf(docs, asked, "d", "x", "q", "y", k=4)
    df = {w: sum(w in (t or "").split() for _, t in texts) for w in words}
    want = []
    for q, y in items:
        ask = (y or "").split()
        scored = []
        for d, t in texts:
            own = (t or "").split()
            s = sum(ask.count(w) / len(ask) * own.count(w) / len(own) * (np.log(122 / (df[w] + 1)) + 1) for w in set(ask) & set(own))
            scored += [(-round(s, 6), -d)] if s > 0 else []
        want += [(q, -d, -s, n) for n, (s, d) in enumerate(sorted(scored)[:4], 1)]
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan and "Join" not in plan  # no row for a text and query is shuffled


def test_cosines_are_made_where_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(search, "TEXTS_BLOCK", 3)
    monkeypatch.setattr(search, "CELLS", 60)
    make = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    odds = 1 / np.arange(1, 41)
    texts = [(i, " ".join(make.choice(words, make.integers(0, 12), p=odds / odds.sum()))) for i in range(150)] + [(150, None)]
    texts += [(200 + i, t) for i, t in texts[:30]]  # copies: ties by id
    items = [(i, " ".join(make.choice(words, 3))) for i in range(8)] + [(8, "none of these"), (9, None), (10, "w1 nowhere")]
    docs, asked = spark.createDataFrame(texts, "d long, x string").repartition(3), spark.createDataFrame(items, "q long, y string")
    df = {w: sum(w in (t or "").split() for _, t in texts) for w in words}
    idf = {w: np.log((len(texts) + 1) / (n + 1)) + 1 for w, n in df.items() if n}
    vector = lambda t: {w: t.split().count(w) / len(t.split()) * idf[w] for w in set((t or "").split()) & set(idf)}
    length = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = []
    for q, y in items:
        a = vector(y)
        scored = [(-round(sum(x * b.get(w, 0) for w, x in a.items()) / (length(a) * length(b)), 6), d) for d, t in texts for b in [vector(t)] if set(a) & set(b)]
        want += [(q, d, -s, n) for n, (s, d) in enumerate(sorted(scored)[:4], 1)]
    for terms in (1 << 18, 5, 0):  # all terms common, most of them rarer, all of them
        monkeypatch.setattr(search, "TERMS", terms)
        got = search.tfidf_cosine(docs, asked, "d", "x", "q", "y", k=4)
        assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()) == sorted(want)
        if terms > 40:
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "HashAggregate" not in plan and "Join" not in plan  # no row for a text and term is shuffled


def test_packs_of_one_kind_are_dealt_to_all_cores(spark):
    packs = spark.range(800, numPartitions=1).selectExpr("id", "'promoted' as status", "'k' as kind")
    subs = spark.range(50).selectExpr("concat('a', id) as agent", "array('k') as pack_types")
    got = sinks.handoff(packs, subs, "status", "kind")
    parts = [n for n in got.rdd.mapPartitions(lambda rows: [sum(len(r.agents) for r in rows)]).collect() if n]
    assert sum(parts) == 800 * 50 and max(parts) <= 800 * 50 // spark.sparkContext.defaultParallelism


def test_rounding_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    x = np.concatenate([np.random.default_rng(3).random(500), np.arange(500) / 1e6 + 5e-7, [0.0, 1.0000005, 2.5e-6]])
    want = [r.s for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("s")).collect()]
    assert search._rounded(x).tolist() == want
