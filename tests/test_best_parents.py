"""Parents of rare and common terms against all pairs counted one by one."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest

from quarry import catalog
from quarry.functions import text as T
from quarry.operators import textstats


def brute(texts):
    sets = [{w for w in re.findall(r"[a-z][a-z0-9_\-]{2,}", t or "") if w not in T.STOP_VERBS} for t in texts]
    freq, best, n_docs = Counter(w for s in sets for w in s), {}, len(texts)
    for (a, b), n in Counter(p for s in sets for p in combinations(sorted(x for x in s if freq[x] > 1), 2)).items():
        pmi = math.log2(n / n_docs / (freq[a] / n_docs * (freq[b] / n_docs)))
        if pmi >= 0.1:
            npmi = 1.0 if n == n_docs else pmi / -math.log2(n / n_docs)
            child, parent = (b, a) if freq[a] >= freq[b] else (a, b)
            best.setdefault(child, []).append((-round(npmi, 9), a, b, parent))
    return {c: (min(rows)[3], round(-min(rows)[0], 6)) for c, rows in best.items()}


@pytest.mark.parametrize("head, run", [(2, 3), (16, 40), (2048, 1 << 20)])
def test_best_parents_are_those_of_all_pairs(spark, monkeypatch, head, run):
    monkeypatch.setattr(textstats, "HEAD", head)
    monkeypatch.setattr(textstats, "RUN", run)
    monkeypatch.setattr(textstats, "TEXTS", 11)
    rng = random.Random(run)
    words = [f"term{i}" for i in range(40)]
    texts = [" ".join(["every", *rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(0, 20))]) for _ in range(60)]
    texts += [f"copied rare{i // 2} also{i // 2} drag" for i in range(10)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.child: (r.parent, round(r.npmi, 6)) for r in textstats.best_parents(docs, "id", "text").collect()}
    assert got == brute(texts) and got["rare0"] == ("also0", 1.0)
    assert textstats.best_parents(docs.limit(0), "id", "text").collect() == []


def test_terms_of_two_documents_have_parents(spark, tmp_path):
    texts = [f"common words{i % 7} of{i % 7}" for i in range(300)]
    texts[5] += " seldom rarely"
    texts[9] += " seldom rarely"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.child: r.parent for r in catalog.QUERIES["a8_taxonomy_parents"](spark, str(tmp_path)).collect()}
    assert got["seldom"] == "rarely"
