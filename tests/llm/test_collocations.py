import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import collocations
from tests.llm import helpers


def plain(rows, least, longest=5, most=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] by counting all phrases."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", helpers.fold(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", *words[i : i + k]] += 1
    often = {p: n for p, n in f.items() if n >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(1, len(q) - len(p) + 1))
    out = []
    for (lang, *w), a in often.items():
        if len(w) < 2 or any(q[0] == lang and len(q) - 1 > len(w) and n >= a and inside(tuple(w), q) for q, n in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], total[lang], score))
    made = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        made += [(lang, i, *x[1:]) for i, x in enumerate(own[:most], 1)]
    return sorted(made)


def texts(seed, n=60):
    rng = random.Random(seed)
    common = ["le", "la", "Zür", "x\x0by", "ab", "AB", "c-d", " ", "é", "😀"]
    phrases = [[rng.choice(common) for _ in range(rng.randrange(2, 8))] for _ in range(4)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts += rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(common)]
            parts.append(rng.choice([" ", " \t", ".", ", ", "\n", "!?", ""]))
        rows.append((" ".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_those_of_counting_all(spark, seed, monkeypatch):
    if seed == 1:  # tables so small that most bits are shared, and many flushes
        monkeypatch.setattr(collocations, "LEAST_BITS", 64)
        monkeypatch.setattr(collocations, "MOST_BITS", 64)
        monkeypatch.setattr(collocations, "FLUSH", 40)
    rows = texts(seed)
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, rank int")
    for least, most in ((3, 2000), (8, 7)):
        got = collocations.collocations(docs, least=least, most=most)
        assert sorted(map(tuple, got.collect())) == plain(rows, least, most=most)


def test_only_phrases_of_frequent_parts_are_counted(spark):
    rows = [("a b c a b d a b e", "en")] * 3
    texts = collocations._texts(spark.createDataFrame(rows, "text string, lang string"), "lang", "text")
    made, _ = collocations.levels(spark.createDataFrame(rows, "text string, lang string"), least=9)
    assert [sorted(r.phrase for r in t.collect()) for t in made] == [["a", "b"], ["a b"], []]
    counted = collocations._phrases_of(texts, 2, collocations._bits(made[0], 2)).collect()
    assert [r.n for r in counted] == [9]


def test_products_beyond_64_bits_are_exact(spark, monkeypatch):
    docs = spark.createDataFrame([("a b", "en")] * 4, "text string, lang string")
    made, total = collocations.levels(docs, least=2)
    big = 10**12 + 7
    made = [t.selectExpr("lang", "phrase", "word", "id", f"{big}L as n", "first", "last", f"transform(heads, x -> {big}L) as heads", f"transform(tails, x -> {big + 2}L) as tails") for t in made]
    monkeypatch.setattr(collocations, "levels", lambda *a: (made, total.selectExpr("lang", "9000000000001L as total")))
    (r,) = collocations.collocations(docs, least=2).collect()
    assert r.score == 1000 * big * 9000000000001 // (big * (big + 2))


def test_odd_rows(spark):
    docs = [(i, t, g) for i, t, g, _ in helpers.ODD]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = collocations.collocations(frame, least=2)
    assert sorted(map(tuple, got.collect())) == plain([r[1:] for r in docs], 2)
    assert collocations.collocations(frame.limit(0)).collect() == []
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_tasks_hold_different_phrases_only(monkeypatch):
    monkeypatch.setattr(collocations, "RUN", 64)
    monkeypatch.setattr(collocations, "HELD", 256)
    held, summed = [], collocations._summed

    def watched(parts):
        held.append(sum(len(x[0]) for x in parts))
        return summed(parts)

    monkeypatch.setattr(collocations, "_summed", watched)
    make = np.random.default_rng(0)
    few = [(make.integers(0, 4, 50, np.uint64), make.integers(0, 4, 50, np.uint64)) for _ in range(400)]
    (batch,) = collocations._gathered(iter(few))
    want = Counter((int(a), int(b)) for x in few for a, b in zip(*x, strict=True))
    assert {(r["first"], r["last"]): r["n"] for r in batch.to_pylist()} == want
    many = [(make.integers(0, 1 << 20, 50, np.uint64), make.integers(0, 4, 50, np.uint64)) for _ in range(400)]
    got, want = Counter(), Counter((int(a), int(b)) for x in many for a, b in zip(*x, strict=True))
    for batch in collocations._gathered(iter(many)):
        got.update({(r["first"], r["last"]): r["n"] for r in batch.to_pylist()})
    assert got == want and max(held) < 256 + 2 * (64 + 50)
    assert list(collocations._gathered(iter([]))) == []


def test_workers_get_texts_in_small_batches(spark):
    docs = spark.createDataFrame([("a b " * 1000, "en")], "text string, lang string").crossJoin(spark.range(4000, numPartitions=1))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    assert max(r.n for r in collocations._texts(docs, "lang", "text").mapInArrow(sizes, "n long").collect()) < 5_000_000
