"""Each stage of the pipeline against a plain version of it, on all that the stage before kept."""

import re

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import secrets
from quarry.llm import site_quality as Q
from quarry.llm._words import SPACED, words
from quarry.session import table
from tests.llm import helpers
from tests.llm.test_search_and_models import plain_quality, scheduled
from tests.llm.test_secrets_plain import scanned


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What goes into each stage, and at last what comes out, as rows."""
    docs = table(spark, sf_dir, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir).collect()
        out.append(rows)
        docs = spark.createDataFrame(rows) if stage is corpus_pipeline.STAGES[-1][1] else spark.createDataFrame(rows, docs.schema)
    return out


def bare(rows):
    return sorted(map(tuple, rows), key=repr)


def test_quality(spark, sf_dir, stages):
    labels = {}
    for r in table(spark, sf_dir, "labels").collect():
        labels[r.doc_id] = min(r.quality, labels.get(r.doc_id, 1))
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in stages[0]]
    kinds = sorted({helpers.fold(x) for _, t, _, _ in docs for x in helpers.words(t)})
    raw = " ".join(kinds).encode()
    hashed = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED).hash
    said, odds = plain_quality(docs, labels, {x: int(h % np.uint64(Q.BUCKETS)) for x, h in zip(kinds, hashed, strict=True)})
    good = {i for i in said if 1 / (1 + np.exp(-said[i] - odds[i])) >= 0.5}
    assert 0 < len(good) < len(docs) and bare(stages[1]) == bare(r for r in stages[0] if r.doc_id in good)


def test_near_duplicates(stages):
    classes = helpers.classes([(r.doc_id, r.text) for r in stages[1]])
    assert len(stages[2]) < len(stages[1]) and bare(stages[2]) == bare(r for r in stages[1] if classes[r.doc_id][1] == r.doc_id)


def least_edits(item, text):
    """Edits of the item to the nearest run of the text, a row of the plain table at a time."""
    n, place = len(text), np.arange(len(text) + 1)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(item):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (text != w), row[1:] + 1)])
        row = np.minimum.accumulate(new - place) + place  # insertions
    return int(row.min())


def test_decontamination(spark, sf_dir, stages):
    number = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", helpers.fold(t))], np.int64)
    items = [coded(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    clean, barely = [], set()
    for r in stages[2]:
        text = coded(r.text or "")
        edits = [(least_edits(x, text), int(0.2 * len(x))) for x in items] if len(text) else []
        if not any(e <= most for e, most in edits):
            clean.append(r)
        elif all(e > most / 2 for e, most in edits):
            barely.add(r.doc_id)  # found with the target recall, not for certain
    got, want = {r.doc_id for r in stages[3]}, {r.doc_id for r in clean}
    assert len(want) < len(stages[2]) and want <= got and got - want <= barely
    assert bare(stages[3]) == bare(r for r in stages[2] if r.doc_id in got)


def test_secrets(spark, sf_dir, stages):
    """On what the stage before kept, a key planted in every ninth text, as these few rows hold none."""
    trees = secrets.train(secrets.labelled_findings(spark))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(r.doc_id, f'{r.text}\napi_key = "{key}" end' if i % 9 == 0 else r.text, r.lang, r.source, r.n_chars + 55 * (i % 9 == 0)) for i, r in enumerate(stages[3])]
    schema = table(spark, sf_dir, "documents").schema
    want = []
    for i, text, lang, source, n in rows:
        clean = text
        for value in sorted((x[0] for x in scanned(trees, text, source) if x[5]), key=len, reverse=True):
            clean = clean.replace(value, "[SECRET]")
        want.append((i, clean, lang, source, n if clean == text else len(clean)))
    got = corpus_pipeline.secret_scan(spark, spark.createDataFrame(rows, schema), sf_dir)
    assert bare(got.collect()) == sorted(want, key=repr) and sum("[SECRET]" in (x[1] or "") for x in want) >= len(rows) // 9


def test_mixing(stages):
    assert bare(r[:5] for r in stages[5]) == bare(stages[4])
    size = {}
    for r in stages[5]:
        size[r.source] = size.get(r.source, 0) + 1
    names = sorted(size, key=lambda x: (x is None, x))
    order = scheduled([-(-size[x] // 64) for x in names], [size[x] ** 0.5 for x in names])
    slots = {}
    for r in stages[5]:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert [slots[t][0] for t in range(len(slots))] == [names[i] for i in order]
    assert len({(r.slot, r.place) for r in stages[5]}) == len(stages[5]) and max(r.place for r in stages[5]) < 64
