"""Patterns run over texts that hold their signs, and find what they find in all texts."""

import pytest
from hypothesis import HealthCheck, given, seed, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.operators import redaction

ODD = ["\u017fecret=abcdefgh12", "TO\u212aEN: abcdefgh12", "ap\u0131-\u212aey=abcdefgh12345678", "AP\u0130KEY abcdefgh12345678", "b\u0131rth", None, "", "call \u0661\u0662\u0663-\u0661\u0662\u0663-\u0661\u0662\u0663\u0664 now"]


@pytest.fixture(scope="module")
def texts():
    out = list(ODD)

    @seed(1)
    @settings(max_examples=12, database=None, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.tuples(*[st.from_regex(p) for _, p in P.active(True).values()]))
    def gather(made):
        out.extend(t for t in made if "\0" not in t and not any(0xD800 <= ord(c) < 0xE000 for c in t))

    gather()
    return out + [f"so {t} and" for t in out if t]


def test_signs_lose_no_match(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    names = P.active(True)
    assert set(P.SIGNS) <= set(names) and {s.get("run", 1) for s in P.SIGNS.values()} <= set(P.RUNS)
    plain = rows.select("i", *[F.coalesce(F.regexp_count("t", F.lit("(?U)" + p)), F.lit(0)).alias(n) for n, (_, p) in names.items()])
    want = sorted(map(tuple, plain.collect()))
    got = redaction.scan_counts(rows, "i", "t", extended=True)
    assert sorted(map(tuple, got.select("i", *names).collect())) == want
    assert all(sum(r[n] for r in want) for n in range(1, len(names) + 1))


def test_patterns_run_over_texts_with_their_signs_only(spark, monkeypatch):
    monkeypatch.setitem(P.PERSONAL, "email_address", "(")  # fails on the first text it is run over
    monkeypatch.setitem(P.SECRETS, "generic_secret", "(")
    monkeypatch.setitem(P.PERSONAL, "us_phone", "(")
    rows = spark.createDataFrame([(1, "plain words, the year 199"), (2, None)], "i long, t string")
    assert [r.secret_count + r.pii_count for r in redaction.scan_counts(rows, "i", "t").collect()] == [0, 0]
    with pytest.raises(Exception, match="REGEX|regex|Unclosed"):
        redaction.scan_counts(rows.select("i", F.concat("t", F.lit(" a@b")).alias("t")), "i", "t").collect()
