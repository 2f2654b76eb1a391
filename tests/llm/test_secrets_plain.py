"""The secret scan against its definitions, a text at a time; and what it makes of planted secrets."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import secrets
from tests.llm import helpers

CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|credential)s?"


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.train(secrets.labelled_findings(spark))


def candidates(text):
    """(value, assigned) in order of search: values given to a name, then bare runs of 20 characters with a digit."""
    given = [m[1] for m in re.finditer(NAMES + r"[\"']?[ \t\n\x0b\f\r]{0,4}[:=][ \t\n\x0b\f\r]{0,4}[\"']?([A-Za-z0-9_+/=!@#$%^&*.\-]{8,})", text, re.I)]
    bare, run = [], ""
    for c in text + "\0":
        if c in CHARS:
            run += c
            continue
        if len(run) >= 20 and any(x.isdigit() for x in run):
            bare.append(run)
        run = ""
    return [(v, v in given) for v in dict.fromkeys(given + bare)]


def places(text, value):
    out, at = [], 0
    while (at := text.find(value, at)) >= 0:
        before, behind = text[at - 1 : at], text[at + len(value) : at + len(value) + 1]
        if not (before and before in CHARS.replace("=", "")) and not (behind and behind in CHARS):
            out.append(at)
            at += len(value)
        else:
            at += 1
    return out or [text.find(value)]


def runs(marks):
    return sum(x != y for x, y in zip(marks, marks[1:], strict=False)) + bool(marks)


def described(value, before, after, path, assigned):
    n = max(1, len(value))
    kinds = ["0" if c in "0123456789" else "a" if "a" <= c <= "z" else "B" if "A" <= c <= "Z" else "_" for c in value]
    voices = ["0" if not "a" <= c <= "z" else "v" if c in "aeiouy" else "c" for c in value.lower()]
    longest, at = 0, 0
    for i in range(1, len(value) + 1):
        if i == len(value) or value[i] != value[at]:
            longest, at = max(longest, i - at), i
    words = sorted(secrets.DICTIONARY, key=len, reverse=True)
    covered = sum(len(m) for m in re.findall("|".join(words), value, re.I))
    return {
        "length": n, "digits": kinds.count("0") / n, "upper": kinds.count("B") / n, "symbols": kinds.count("_") / n, "distinct": len(set(value)) / n,
        "entropy": -sum(value.count(c) / n * math.log2(value.count(c) / n) for c in set(value)), "class_runs": runs(kinds) / n, "vowel_runs": runs(voices) / n,
        "longest_run": longest / n, "dictionary": covered / n, "hex": bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)),
        "uuid": bool(re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)),
        "placeholder": bool(re.search(r"x{4,}|0{6,}|1234567|abcdef|your|example|changeme|placeholder|(.)\1{5}", value, re.I)),
        "secret_word": bool(re.search("token|secret|passw|pwd|api.?key|access.?key|credential|auth|bearer|private", before, re.I)),
        "plain_word": bool(re.search("sha|md5|commit|checksum|digest|hash|uuid|guid|revision|etag|integrity|example|sample|placeholder|version", before, re.I) or re.match(r"\W*(example|placeholder)", after, re.I | re.A)),
        "plain_path": bool(re.search("test|example|fixture|sample|doc|mock|vendor|lock", path, re.I)), "assigned": assigned,
    }


def votes(trees, made):
    def walk(tree):
        while not isinstance(tree, float):
            at, limit, left, right = tree
            tree = left if made[secrets.FEATURES[at]] <= limit else right
        return tree

    return sum(walk(t) for t in trees) / len(trees)


def scanned(trees, text, path):
    out = []
    for value, assigned in candidates(text or ""):
        best = max(votes(trees, described(value, text[max(0, i - 40) : i], text[i + len(value) : i + len(value) + 20], path or "", assigned)) for i in places(text, value))
        out.append((value, text.find(value) + 1, text.count(value), assigned, round(best, 9), best > 0.5))
    return sorted(out, key=lambda x: x[1])


def made_texts(seed, n=150):
    rng = random.Random(seed)
    code = lambda m, of=CHARS[:62]: "".join(rng.choice(of) for _ in range(m))
    word = lambda: rng.choice(secrets.DICTIONARY)
    texts = []
    for _ in range(n):
        kept = code(rng.randrange(20, 60))
        parts = [
            lambda: f'{rng.choice(["api_key", "the token", "client secret", "PASSWORD", "pwd"])}{rng.choice([" = ", ": ", "=", ":=  "])}{rng.choice(["", chr(34)])}{code(rng.randrange(8, 70))}',
            lambda: f"{rng.choice(['commit', 'sha256:', 'see', 'bearer', 'auth'])} {code(rng.choice([32, 40, 64]), '0123456789abcdef')}",
            lambda: "-".join(code(m, "0123456789abcdef") for m in (8, 4, 4, 4, 12)), lambda: "_".join(word() for _ in range(4)) + f"_{rng.randrange(99)}",
            lambda: "x" * 20 + "1234", lambda: f"{word()} {kept}", lambda: f"token {kept}x1", lambda: f"the secret={kept}", lambda: "Über naïve \U0001f600 straße", lambda: " ".join(word() for _ in range(8)),
        ]
        texts.append(rng.choice([" ", "\n", ", ", ";"]).join(rng.choice(parts)() for _ in range(rng.randrange(0, 9))))
    return [*texts, None, "", "a" * 30_000 + "1", "key " * 5_000]


def test_findings_are_what_their_definition_says(spark, trees):
    texts = made_texts(4)
    paths = ["src0", "tests/unit", None]
    docs = [(i, t, paths[i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("findings", "_given", "_text", "f")})
    found = secrets.with_findings(df, trees)
    assert found.columns == [*df.columns, "findings_"]
    rows = found.collect()
    assert {(r.findings, r._given, r.f) for r in rows} == {("own",) * 3}
    for r in rows:
        got = [(f.value, f.start, f.times, f.assigned, round(f.score, 9), f.is_secret) for f in r.findings_]
        assert got == sorted(scanned(trees, docs[r.doc_id][1], docs[r.doc_id][2]), key=lambda x: x[1]), r.doc_id
    clean = secrets.redacted(df, trees)
    assert clean.schema == df.schema
    for r in clean.collect():
        text = docs[r.doc_id][1]
        for value in sorted((x[0] for x in scanned(trees, text, docs[r.doc_id][2]) if x[5]), key=len, reverse=True):
            text = text.replace(value, "[SECRET]")
        assert r.text == text and r.findings == "own"


def test_planted_secrets_go_and_prose_stays(spark, trees, sf_dir):
    """Of the documents: precision and recall over strings that look like keys of known makers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    shape = re.compile(r"\b(AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bap]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)")
    planted, clean = {}, {r.doc_id: r.text for r in secrets.redacted(docs, trees).collect()}
    for r in docs.collect():
        for m in shape.finditer(r.text or ""):
            planted[r.doc_id, m[1]] = m[1] not in clean[r.doc_id]
        words = helpers.words(r.text)
        if r.text and clean[r.doc_id] != r.text:
            lost = set(words) - set(helpers.words(clean[r.doc_id]))
            assert all(any(c.isdigit() for c in w) or re.search(r"[:=]", w) or len(w) >= 8 for w in lost)
    if planted:
        assert sum(planted.values()) / len(planted) >= 0.95
