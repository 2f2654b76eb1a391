"""Operators that SQL does not express, against plain Python on small fixtures, and edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import patterns as P
from quarry.functions import text as T
from quarry.operators import chunking, dedup, evaluate, governance, graph, html, intervals, provenance, redaction, search, sessions


def jaccard_of(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def sequential(docs, threshold, bands, n):
    """A MinHash index fed one text after another."""
    out, hashes, kept = {}, {}, []

    def shingles(text):
        t = re.findall("[a-z0-9]+", text.lower())
        return set(t) if len(t) < 4 else {" ".join(t[i : i + 4]) for i in range(len(t) - 3)}

    for i, text in sorted(docs):
        digest = hashlib.sha256(text.encode()).hexdigest()
        if digest in hashes:
            out[i] = ("exact", hashes[digest])
            continue
        s = shingles(text)
        sig = [min((hashlib.sha256(f"{k}:{x}".encode()).hexdigest()[:16] for x in s), default="f" * 16) for k in range(n)]
        r = n // bands
        near = [(jaccard_of(sig, g), -j, j) for j, g in kept if any(sig[b * r : b * r + r] == g[b * r : b * r + r] for b in range(bands))]
        best = max((x for x in near if x[0] >= threshold), default=None)
        if best:
            out[i] = ("near", best[2])
        else:
            out[i] = ("unique", None)
            hashes[digest] = i
            kept.append((i, sig))
    return out


def families(seed, n=60):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("ab cd ef gh ij".split())
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv".split()) for _ in range(rng.randrange(0, 40)))))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_decisions_are_those_of_a_sequential_index(spark, seed):
    docs = families(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.id: (r.method, r.duplicate_of) for r in dedup.greedy_decisions(df, "doc_id", "text", 16, 4, 0.6).collect()}
    assert found == sequential(docs, 0.6, 4, 16)


def test_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup.greedy_decisions(empty, "doc_id", "text").collect() == []
    assert dedup.duplicate_stats(dedup.exact_decisions(empty, "doc_id", "text")).first().duplicate_rate == 0


def test_cascade_precedence(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, text), (2, text), (3, text + " nu"), (4, "quite another text of its own making here")]
    got = {r.id: (r.method, r.duplicate_of) for r in dedup.cascade_decisions(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 32, 16, 0.6).collect()}
    assert got[2] == ("exact", 1) and got[3][0] in ("near", "simhash") and got[1] == got[4] == ("unique", None)


def test_spaced_accepts_after_the_gap(spark):
    rows = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 5, 10, 11, 19, 20])], "k string, i int, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.i for r in sessions.spaced(rows, "k", "i", "ts", 10).orderBy("i").collect()] == [0, 2, 5]
    assert [r.i for r in sessions.spaced(rows, "k", "i", "ts", 10, strict=True).orderBy("i").collect()] == [0, 3]


def test_fixed_windows_begin_with_the_first_word_left(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 4.9, 5.2, "b"), (1, 5.0, 5.5, "c"), (1, 9.0, 9.1, "d")], "k int, s double, e double, w string")
    got = [(r.start, r.end, r.text) for r in sessions.fixed_windows(rows, "k", "s", "e", "w", 5.0).orderBy("segment").collect()]
    assert got == [(0.0, 5.2, "a b"), (5.0, 9.1, "c d")]


def test_alignment_takes_both_ends_of_the_window(spark):
    a = spark.createDataFrame([(1, 1, 10.0), (1, 2, 100.0)], "k int, action_id int, ts double")
    s = spark.createDataFrame([(1, 0, 0.0, 5.0, "x", 0.5), (1, 1, 15.0, 16.0, "y", 1.0), (1, 2, 15.1, 16.0, "z", 1.0)], "k int, pos int, start double, end double, text string, confidence double")
    got = {r.action_id: (r.text, r.confidence, r.start, r.end) for r in intervals.aligned(a, s, "k", 5.0).collect()}
    assert got == {1: ("x y", 0.75, 0.0, 16.0), 2: ("", 0.0, 100.0, 100.0)}
    assert intervals.aligned(a, s, "k", 5.0, 0.5).count() == 1


def test_merkle_roots_and_tampering(spark):
    rows = [(k, i, f"h{k}-{i}") for k, n in ((1, 1), (2, 2), (3, 7), (4, 16)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, h string")
    got = {r.k: (r.n, r.root) for r in provenance.merkle_roots(df, "k", ["i"], "h").collect()}
    for k in got:
        own = [h for a, _, h in rows if a == k]
        assert got[k] == (len(own), provenance.merkle_root(own))
    assert provenance.merkle_root([]) == hashlib.sha256(b"").hexdigest()
    assert provenance.merkle_roots(df.limit(0), "k", ["i"], "h").collect() == []


def test_chain_breaks_where_it_was_changed(spark):
    rows = spark.createDataFrame([("u", i, f"p{i}") for i in range(5)], "k string, i int, p string")
    chain = provenance.chained(rows, "k", ["i"], F.col("p"))
    assert provenance.broken_links(chain, "k", ["i"], F.col("payload"), "entry_hash").count() == 0
    bent = chain.withColumn("payload", F.when(F.col("i") == 2, "other").otherwise(F.col("payload")))
    assert [r.i for r in provenance.broken_links(bent, "k", ["i"], F.col("payload"), "entry_hash").collect()] == [2]
    assert provenance.canonical_json('{"b": [1, 2], "a": "é"}') == '{"a": "\\u00e9", "b": [1, 2]}'


def test_redaction_merges_overlaps_and_scans_clean(spark):
    rows = [(1, "id A1234567 end"), (2, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (3, "see 1.0@2.0 and a.b@c.org"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in redaction.redacted(df, "doc_id", "text").collect()}
    assert got[1].text.count("[") == 1 and "A1234567" not in got[1].text
    assert got[2].text == '[GENERIC_SECRET]" x' and got[4].text is None and got[5].text == ""
    assert "1.0@2.0" in got[3].text and "[EMAIL_ADDRESS]" in got[3].text
    again = redaction.findings(spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string"), "doc_id", "text")
    assert again.count() == 0
    assert len(P.active()) == 33 and len(P.active(True)) == 46


def test_finding_priorities():
    spans = [(0, 4, "a", "pii"), (2, 8, "b", "pii"), (9, 10, "c", "pii")]
    assert redaction.merged(spans) == [(0, 8, "a"), (9, 10, "c")]
    assert [x[2] for x in redaction.resolved(spans)] == ["b", "c"]


def test_lcs_and_rouge(spark):
    rng = random.Random(3)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        return row[-1]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        assert evaluate.lcs(a, b) == slow(a, b)
    df = spark.createDataFrame([("a b c", "a c"), ("", ""), ("a", "")], "p string, t string")
    assert [round(r.rouge_l, 3) for r in evaluate.rouge_l(df, "p", "t").collect()] == [0.8, 1.0, 0.0]


def test_oracle_rules(spark):
    assert evaluate.oracle_share("Hello World", ["hello", "^w", "[bad"]) == pytest.approx(1 / 3)
    df = spark.createDataFrame([("x", ["x"]), (None, [])], "o string, r array<string>")
    assert [r.oracle for r in evaluate.with_oracle_share(df, "o", "r").collect()] == [1.0, 1.0]


def test_chunks_cover_their_text(spark):
    text = "One sentence here. Another one there! " * 40
    assert all(len(t) <= 600 for t, _, _ in chunking.by_sentences(text))
    assert "".join(t for t, _, _ in chunking.by_sentences(text, overlap=0)).replace(" ", "") == text.replace(" ", "")
    md = "intro\n# A\nx\n## B\ny"
    assert [t for t, _, _ in chunking.by_headings(md)] == ["intro", "# A\nx", "## B\ny"]
    assert [t for t, _, _ in chunking.by_paragraphs("a\n\nb\n\n" + "c" * 600)] == ["a\n\nb", "c" * 600]
    assert [t for t, _, _ in chunking.scored("red fish swims\n\nred fish swims fast\n\nmoon rocks")] == ["red fish swims\n\nred fish swims fast", "moon rocks"]
    assert chunking.recursively("# A\nx\n\n# B\n" + "y z. " * 300)[0][0] == "# A\nx"
    assert chunking.overlap_length("abc de", "de fg") == 2
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for strategy in chunking.STRATEGIES:
        assert chunking.chunked(df, "doc_id", "text", strategy).count() == 0
    assert chunking.fixed(df, "doc_id", "text").count() == 0


def test_markdown_triples(spark):
    md = "# Tools\n| a | b |\n|---|---|\nHammer: drives nails\n- Saw is a tool\n- Glue: sticks well\n- when: 2024-01-02"
    got = [(r.subject, r.predicate, r.object) for r in graph.markdown_triples(spark.createDataFrame([(1, md)], "i int, t string"), "i", "t").orderBy("line").collect()]
    assert ("Tools", "is_section", "document") in got and ("a", "related_to", "b") in got
    assert ("Hammer", "defined_as", "drives nails") in got and ("Hammer", "belongs_to_section", "Tools") in got
    assert ("Saw", "is_a", "tool") in got and ("Glue", "defined_as", "sticks well") in got and len(got) == 6


def test_minhash_cuts_digests_once(spark):
    signed = spark.createDataFrame([(["a b", "c"],), ([],)], "s array<string>").select("s", dedup.minhash(F.col("s"), 3).alias("g"))
    for r in signed.collect():
        assert r.g == [min((hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()[:16] for x in r.s), default="f" * 16) for seed in range(3)]
    assert "substring(sha2" not in signed._jdf.queryExecution().analyzed().toString()


def test_derived_hashes_by_batches(spark):
    sets = [[], None, [0, 2**32 - 1, 2**31 - 1, 2**31, 2**31 - 2], [7], list(range(0, 2**32, 60_013)), []]
    signed = spark.createDataFrame(list(enumerate(sets)), "i int, h array<bigint>").select("i", dedup.derived(F.col("h"), 6).alias("s"))
    for r in signed.collect():
        assert r.s == [min(((x * a + b) % dedup.PRIME for x in sets[r.i] or []), default=dedup.PRIME) for a, b in dedup.FAMILY[:6]]
    # no lambda of SQL runs for each shingle and seed
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan


def test_triples_of_a_long_run_of_words(spark):
    words = "w " * 20_000
    texts = [(1, f"{words}is a b was authored by {words}"), (2, "x and y are related and are related z and t are relatedness and u")]
    got = [(r.i, len(r.subject), r.predicate, len(r.object)) for r in graph.triples(spark.createDataFrame(texts, "i int, t string"), "i", "t").orderBy("i", "pos").collect()]
    assert got == [(1, 40_006, "authored_by", 39_999), (1, 39_999, "is_a", 40_017), (2, 37, "related_to", 1)]


def test_triples_and_groups(spark):
    df = spark.createDataFrame([(1, "Spark was created by Matei. Spark is built by Matei. Spark uses Scala.")], "i int, t string")
    found = graph.triples(df, "i", "t")
    assert {(r.subject, r.predicate, r.object) for r in found.collect()} == {("Spark", "created_by", "Matei"), ("Spark", "uses", "Scala")}
    assert graph.first_by_group(found, ["i", "pos"]).count() == 2
    nodes, edges = graph.resolve(found, ["i", "pos"])
    assert nodes.count() == 3 and edges.count() == 2


def test_neighbours_of_an_unknown_node(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "a")], "src string, predicate string, dst string")
    assert graph.neighbours(e, spark.createDataFrame([("z",)], "node string"), 2).count() == 0
    got = graph.neighbours(e, spark.createDataFrame([("a",)], "node string"), 5).collect()
    assert {(r.src, r.dst, r.level) for r in got} == {("a", "b", 1), ("b", "a", 2)}


def test_structured_layers():
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Pen","offers":{"price":"1,299.50","priceCurrency":"EUR","availability":"https://schema.org/InStock"}}</script><meta property="og:title" content="no">'
    got = html.structured(ld)
    assert (got["name"], got["price"], got["currency"], got["availability"], got["source"]) == ("Pen", 1299.5, "EUR", "InStock", "json-ld")
    assert html.structured('<span itemprop="name">Cup</span>')["source"] == "microdata"
    assert html.structured('<meta property="og:title" content="T">')["source"] == "meta"
    assert html.structured("<h1>Head <b>line</b></h1>")["title"] == "Head line"
    assert html.structured(None) == {} and html.structured("<script type='application/ld+json'>{bad</script>") == {}


def test_html_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "http://h/a"), (2, "", "http://h/a"), (3, '<a href="/x">x</a><meta content="c" name="n"><meta name="n" content="d">', "http://h/a")], "i int, h string, u string")
    got = {r.i: r for r in df.select("i", html.links(F.col("h"), F.col("u")).alias("l"), html.meta_tags(F.col("h")).alias("m")).collect()}
    assert got[3].l == ["http://h/x"] and got[3].m == {"n": "c"} and got[1].l is None
    assert html.content_chunks(df, "i", "h").where("i < 3").count() == 0


def test_search_edge_cases(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "i long, v array<float>")
    got = [(r.id, r.score) for r in search.nearest(v, v.where("i = 2"), "i", "v", 3).orderBy("rank").collect()]
    assert got == [(3, 1.0), (2, 1.0), (1, 0.0)]
    assert search.nearest(v, v.limit(0), "i", "v").count() == 0


def test_governance_edge_cases(spark):
    df = spark.createDataFrame([("1.2.3", "2.0.0"), ("1.2.3", "1.2.4"), ("x", "1.0.0"), ("1.2.3", "0.9.9")], "a string, b string")
    assert [r[0] for r in df.select(governance.bump_kind(F.col("a"), F.col("b"))).collect()] == ["major", "patch", "unknown", "minor"]
    one = spark.createDataFrame([(None,)], "s string")
    assert one.select(governance.gates(*[F.lit(None)] * 6)).first()[0] == ["provenance", "rights_status", "replay_pass_rate", "deterministic", "redaction_complete", "human_signoff"]
    assert one.select(governance.template("Hi {{who}}{{ gone }}!", {"who": F.lit("you")})).first()[0] == "Hi you!"
    assert one.select(governance.requirement(F.lit("My_Pkg==1.2 ; x"))["package"]).first()[0] == "my-pkg"
    assert one.select(governance.overridden(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))).first()[0] == {"a": 2}


def test_text_functions(spark):
    df = spark.createDataFrame([("Über straße naïve",), ("",), (None,)], "t string")
    got = df.select(T.ascii_tokens(F.col("t")), T.unicode_tokens(F.col("t")), T.char_shingles(F.col("t"))).collect()
    assert got[0][0] == ["ber", "stra", "e", "na", "ve"] and got[0][1] == ["über", "straße", "naïve"] and got[1][2] == [""] and got[2][0] is None
