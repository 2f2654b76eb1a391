"""Secrets of any length, judged at every place."""

import hashlib

import pytest

from quarry.llm import secrets

KEY = "".join(hashlib.sha256(str(i).encode()).hexdigest()[:31] + "Zq" for i in range(15))[:480]
LATE = "".join(c for c in KEY * 3 if not c.isdigit())[:230] + "7Kd9"
SHORT = "9fK2mQ7xVb4TzL8wRc3NpY6hJd5sGa1E"


@pytest.fixture(scope="module")
def trees(spark):
    return secrets.train(secrets.labelled_findings(spark))


def scan(spark, trees, *texts):
    docs = spark.createDataFrame([(i, "src0", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    found = {r.doc_id: r.findings for r in secrets.with_findings(docs, trees).collect()}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, trees).collect()}
    return [(found[i], clean[i]) for i in range(len(texts))]


def test_long_secrets_are_found_whole(spark, trees):
    given, bearer, late = scan(spark, trees, f'token = "{KEY}" end', f"Authorization: Bearer {KEY} end", f"auth token {LATE} end")
    assert [f.value for f in given[0]] == [KEY] and given[1] == 'token = "[SECRET]" end'
    assert [f.value for f in bearer[0]] == [KEY] and bearer[1] == "Authorization: Bearer [SECRET] end"
    assert [f.value for f in late[0]] == [LATE]


def test_the_highest_vote_of_all_places_counts(spark, trees):
    alone, plain = (scan(spark, trees, t)[0][0][0] for t in (f"the auth token {SHORT} x", f"sha256 digest {SHORT} x"))
    assert alone.score > plain.score
    far = " and so on it goes for a while with nothing near it" * 3
    first, inside = scan(spark, trees, f"sha256 digest {SHORT}{far} the auth token {SHORT} x", f"é sha256 digest a{SHORT}{far} the auth token {SHORT} x")
    assert first[0][0].score == alone.score and first[0][0].times == 2 and first[0][0].start == 15
    assert {f.value: f.score for f in inside[0]}[SHORT] == alone.score
