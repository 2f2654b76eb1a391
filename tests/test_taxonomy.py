import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from quarry.functions import text as T
from quarry.operators import graph, textstats


@pytest.mark.parametrize("block, least, share", [(2, 2, 0.0), (128, 1, 0.3)])
def test_pairs_are_those_of_counting_all(spark, block, least, share, monkeypatch):
    monkeypatch.setattr(textstats, "BLOCK", block)
    rng = random.Random(block)
    words = [f"term{i}" for i in range(12)] + ["every", sorted(T.STOP_VERBS)[0]]
    texts = [" ".join(["every", *rng.choices(words, k=rng.randrange(0, 14))]) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [{w for w in re.findall(r"[a-z][a-z0-9_\-]{2,}", t or "") if w not in T.STOP_VERBS} for t in texts]
    often = Counter(w for s in sets for w in s)
    often = {w: n for w, n in often.items() if n >= max(least, math.ceil(share * len(texts)))}
    wanted = {}
    for (a, b), n in Counter(p for s in sets for p in combinations(sorted(s & set(often)), 2)).items():
        pmi = math.log2(n / len(texts) / (often[a] / len(texts) * often[b] / len(texts)))
        if pmi >= 0.1:
            wanted[a, b] = (n, round(pmi, 6), often[a], often[b])
    got = textstats.pmi_pairs(docs, "id", "text", least, 0.1, share)
    assert {(r.term_a, r.term_b): (r.n, round(r.pmi, 6), r.freq_a, r.freq_b) for r in got.collect()} == wanted and wanted
    assert textstats.pmi_pairs(docs.limit(0), "id", "text").collect() == []


def test_terms_inside_others_of_any_length(spark):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choices("ab", k=rng.randrange(1, 14))) for _ in range(80)} | {"ab" * 400, "x" + "ab" * 400, "é\nab"})
    got = graph.contained_terms(spark.createDataFrame([(t,) for t in [*terms, terms[3]]], "term string")).collect()
    assert sorted((r.term, r.other) for r in got) == sorted((a, b) for a in terms for b in terms if 3 <= len(a) < len(b) and a in b)


def test_texts_stay_where_they_are_read_for_pairs_and_keywords(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 3} delta{i % 5}") for i in range(40)] + [(40, None)], "id long, text string")
    monkeypatch.setattr(textstats, "_by_blocks", None)
    monkeypatch.setattr(textstats, "TEXTS", 7)
    pairs = textstats.pmi_pairs(docs, "id", "text", 1, -9.0, 0.02)
    want = Counter(p for i in range(40) for p in combinations(sorted(["alpha", "beta", f"gamma{i % 3}", f"delta{i % 5}"]), 2))
    assert {(r.term_a, r.term_b): r.n for r in pairs.collect()} == want
    plan = textstats.keywords(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\([^)]*term", plan)
