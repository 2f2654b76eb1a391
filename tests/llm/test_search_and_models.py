import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from quarry.llm import divergence as V
from quarry.llm import pfair as M
from quarry.llm import reputation as R
from quarry.llm import secrets as S
from quarry.llm import site_quality as Q
from quarry.llm import suffix_tree as T
from quarry.llm._words import PLAIN, words
from tests.llm import helpers

DOCS = "doc_id long, text string, lang string, source string"


def odd(spark):
    return spark.createDataFrame(helpers.ODD, DOCS).withColumn("id", F.lit("clash")).withColumn("host", F.lit("x"))


# decontamination


def edit_distance(item, text):
    """Least edits of item to any run of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_exact_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(4, size=int(rng.integers(1, n))).astype(np.uint64) for n in (70, 80))
        assert D.distance(a, b, 99)[0] == edit_distance(a.tolist(), b.tolist())


def contaminated(seed=5, n_items=40, edits=0.2):
    rng = random.Random(seed)
    vocab = helpers.vocabulary(2000, rng)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 70)))) for i in range(n_items)]
    docs, truth = [], {}
    for d in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        if d % 2:
            i = rng.randrange(n_items)
            p = items[i][1].split()
            done = rng.randrange(0, int(edits * len(p)) + 1)
            for _ in range(done):
                at = rng.randrange(len(p))
                p[at : at + 1] = rng.choice([[], [rng.choice(vocab)], [p[at], rng.choice(vocab)]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", "!!", ","]) for x in p]
            truth[d, i] = done
        docs.append((d, " ".join(w)))
    return docs, items, truth


def test_items_are_found_and_nothing_else(spark):
    docs, items, truth = contaminated()
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.id, r.item_id): r.edits for r in got.collect()}
    plain = lambda t: [x for x in __import__("re").split(r"[^a-z0-9]+", t.lower()) if x]
    slow = {}
    for d, t in docs:
        for i, x in items:
            a = plain(x)
            if (e := edit_distance(a, plain(t))) <= int(0.2 * len(a)):
                slow[d, i] = e
    assert set(got) <= set(slow) and all(slow[k] <= got[k] for k in got)
    assert len(got) >= 0.97 * len(slow)
    verbatim = {k for k, n in truth.items() if n == 0}
    assert verbatim <= set(got)


def test_odd_texts_hold_nothing(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!?"), (None, "one two three four five six seven"), (4, "word " * 20)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in D.contained_items(odd(spark), items).collect()}
    assert got == {(6, 4)}
    kept = D.decontaminated(odd(spark), items)
    assert kept.count() == len(helpers.ODD) - 1 and kept.columns == odd(spark).columns
    assert D.contained_items(odd(spark).limit(0), items).count() == 0
    assert D.contained_items(odd(spark), items.limit(0)).count() == 0


def test_short_items_are_found_exactly(spark):
    items = spark.createDataFrame([(1, "Solo"), (2, "two words"), (3, "a three word"), (4, "now four of them"), (None, "no id here")], "item_id long, text string")
    docs = [(1, "so lo"), (2, "a solo"), (3, "two"), (4, "words two words"), (5, "a three  WORD, now"), (6, "now four of"), (7, "x now four; of them"), (8, "two"), (9, "words"), (10, "no id here")]
    got = {(r.id, r.item_id, r.first_word, r.edits) for r in D.contained_items(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), items).collect()}
    assert got == {(2, 1, 1, 0), (4, 2, 1, 0), (5, 3, 0, 0), (7, 4, 1, 0), (10, None, 0, 0)}


def test_rows_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "x " + item), (5, item + " y"), (5, "clean"), (None, "clean too"), (6, None)]
    got = D.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[2], rows[3], rows[4]], key=repr)


def test_recall_is_measured_and_reached():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 80))) for _ in range(300)]
    index = D.build(list(range(300)), texts, 0.2, 0.99)
    assert set(index.recall) == set(index.reps) and min(index.recall.values()) >= 0.99


def test_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(D, "GIVE_UP", 9)
    with pytest.raises(RuntimeError, match="recall"):
        D.build([1], ["a b c d e f g h i j"], 0.9, 1.0)


def test_items_come_in_blocks(spark, monkeypatch):
    docs, items, _ = contaminated(7, 12, 0.0)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in D.contained_items(d, i).collect()}
    monkeypatch.setattr(D, "BLOCK", 5)
    assert {tuple(r) for r in D.contained_items(d, i).collect()} == whole


# suffix tree


def train_texts():
    rng = random.Random(2)
    out = []
    for i in range(300):
        w = []
        while len(w) < 30:
            w += rng.choice([["new", "york", "city"], ["p", "m", "q"], ["r", "m", "s"], ["san", "jose"], ["new", "car"], [rng.choice("abcdefgh")]])
        out.append((i, " ".join(w)))
    return out


def test_base_scores_are_the_formula(spark):
    docs = [*train_texts(), (None, "new x"), (1001, None), (1002, ""), (1003, "Zzz NEW")]
    rows = T.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*helpers.words(helpers.fold(t)), ""]
    c = Counter(x for i, t in docs if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    by = {i: t for i, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(by[r.id])
        assert (r.flag, r.n_tokens, r.n_known, r.train_tokens) == (held(r.id), len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own), rel=1e-9)
    gain = sum(r.score - r.base_score for r in rows if r.flag)
    assert gain > 0  # contexts help on texts that were held out


def test_states_are_distributions(spark):
    """Probabilities of all known words and of any unknown one sum to one after every context."""
    docs = spark.createDataFrame(train_texts(), "doc_id long, text string")
    counts = T.token_counts(docs)
    tree = T.fit(docs, counts, depth=3)
    assert len(tree.keys) >= 2 and len(tree.keys[0]) >= 2 and len(tree.keys[1]) >= 1
    root = (tree.counts + 0.1) / (tree.total + 0.1 * (tree.distinct + 1))
    unknown = 0.1 / (tree.total + 0.1 * (tree.distinct + 1))
    for context in (["new"], ["p", "m"], ["r", "m"], ["new", "york"], ["a", "new"], ["zz"], []):
        token = np.concatenate([T._tokens(*_buffers(" ".join(context)))[1][:-1], [np.uint64(0)]])
        keys = [k[-1:].repeat(len(tree.words) + 1) for k in T._contexts(np.zeros(len(token), int), token, 3)]
        gain, explicit = T._descend(tree, keys, np.concatenate([tree.words, [np.uint64(12345)]]))
        p = 10.0 ** gain * np.where(explicit, 1.0, np.concatenate([root, [unknown]]))
        assert p.sum() == pytest.approx(1.0, abs=1e-6)


def plain_tree(texts, depth, context_root, entry_root, divergence=0.02, smoothing=10.0):
    """A function that gives the log10 probability of a text, by a tree of dicts. texts: lists of tokens."""
    seen = Counter(x for t in texts for x in t)
    total, distinct = sum(seen.values()), len(seen)
    least, fewest = max(2.0, context_root * total**0.5), max(2.0, entry_root * total**0.5)
    known = {w for w, n in seen.items() if n >= min(least, fewest)}
    root = lambda w: (seen[w] + 0.1) / (total + 0.1 * (distinct + 1))
    follows = {}
    for t in texts:
        for i in range(len(t)):
            for k in range(1, min(depth, i) + 1):
                follows.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
    states = {}

    def p(context, w):
        factor = 1.0
        for k in range(len(context), 0, -1):
            if (state := states.get(tuple(context[-k:]))) is not None:
                entries, rest = state
                if w in entries:
                    return factor * entries[w]
                factor *= rest
        return factor * root(w)

    for k in range(1, depth + 1):
        made = {}
        for context, after in follows.items():
            n = sum(after.values())
            # a context is looked at if it and all its suffixes are frequent
            if len(context) != k or any(sum(follows[context[-j:]].values()) < least for j in range(1, k + 1)):
                continue
            entries = {w: m for w, m in after.items() if w in known and m >= fewest}
            before = {w: p(context[1:], w) for w in entries}
            rest_n, rest_p = n - sum(entries.values()), max(1e-12, 1 - sum(before.values()))
            gain = sum(m * math.log(m / n / before[w]) for w, m in entries.items()) + (rest_n * math.log(rest_n / n / rest_p) if rest_n else 0)
            free = len(entries)
            if 2 * gain > free + 4 * math.sqrt(2 * free + 1) and gain / n > divergence:
                kept = {w: (m + smoothing * before[w]) / (n + smoothing) for w, m in entries.items()}
                made[context] = kept, max(1e-9, 1 - sum(kept.values())) / rest_p
        states.update(made)
    return lambda t: sum(math.log10(p(t[max(0, i - depth) : i], t[i])) for i in range(len(t))), states


@pytest.mark.parametrize("roots", [(0.5, 0.01), (0.05, 0.05), (0.2, 0.02)])
def test_scores_are_those_of_a_plain_tree(spark, roots):
    far = ["k l m n one", "q l m n two", "l m n three", "it was the best", "it was the worst"]  # what follows hangs on four words
    docs = train_texts() + [(1000 + i, " ".join(far[(i * j) % 5] for j in range(1, 4))) for i in range(100)] + [(None, "new x"), (5001, None), (5002, "Zzz NEW york city"), (5003, "x y"), (5003, "x y")]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*helpers.words(helpers.fold(t)), ""]
    score, states = plain_tree([tokens(t) for i, t in docs if not held(i)], 4, *roots)
    assert {len(s) for s in states} >= ({1, 2} if roots[0] == 0.5 else {1, 2, 4})
    rows = T.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), context_root=roots[0], entry_root=roots[1]).collect()
    assert sorted((r.id is None, r.id) for r in rows) == sorted((i is None, i) for i, _ in docs)
    by = dict(docs)
    for r in rows:
        assert r.score == pytest.approx(score(tokens(by[r.id])), rel=1e-6), r


def test_the_tree_grows_with_the_corpus(spark):
    rng = random.Random(4)
    pairs = {f"w{i}": [f"w{rng.randrange(300)}" for _ in range(3)] for i in range(300)}

    def text():
        w = [f"w{int(rng.paretovariate(0.7)) % 300}"]
        while len(w) < 200:
            w.append(rng.choice(pairs[w[-1]]))
        return " ".join(w)

    sizes = []
    for n in (40, 640):
        docs = spark.createDataFrame([(i, text()) for i in range(n)], "doc_id long, text string")
        tree = T.fit(docs, T.token_counts(docs))
        sizes.append((sum(map(len, tree.keys)), sum(map(len, tree.entry))))
    assert all(b > 1.5 * a for a, b in zip(*sizes, strict=True))


def _buffers(text):
    raw = text.encode()
    return np.frombuffer(raw, np.uint8), np.array([0, len(raw)])


def test_scores_of_odd_rows(spark):
    got = T.scored(odd(spark)).collect()
    assert len(got) == len(helpers.ODD) and all(r.n_tokens >= 1 and r.score == r.score for r in got)
    assert T.scored(odd(spark).limit(0)).count() == 0


# quality rules


def test_rule_counts(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice("ab #|\n\t") for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(1000 + k, t) for k, (_, t, _, _) in enumerate(helpers.ODD)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    by = dict(docs)
    for r in V.judged(rows).collect():
        want = helpers.rule_counts(by[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_divergence_is_jensen_shannon(spark):
    df = spark.createDataFrame([([1, 3], 4, [0.5, 0.5]), ([5, 0], 5, [0.0, 1.0]), ([2, 2], 4, [0.5, 0.5])], "c array<int>, n long, q array<double>")
    got = [r[0] for r in df.select(V.distance(F.col("c"), F.col("n"), F.col("q"))).collect()]
    p, q = np.array([0.25, 0.75]), np.array([0.5, 0.5])
    m = (p + q) / 2
    assert got[0] == pytest.approx(np.sqrt(((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2)) and got[1] == pytest.approx(1.0) and got[2] == 0.0


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice("the of and house river walked slowly in garden with a to is stone".split()) for _ in range(120)) + "."
    docs = [(i, prose(), "en") for i in range(60)] + [(99, " ".join(f"{rng.randrange(10**9)}%%%$$$" for _ in range(120)), "en")]
    kept = {r.id: r.kept for r in V.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not kept[99] and all(kept[i] for i in range(60))


def test_long_texts_without_common_words_fail(spark):
    """Letter-only gibberish and lists of keywords, in normal case and spacing; short clean texts stay."""
    rng = random.Random(9)
    common, rare = V.COMMON["en"], helpers.vocabulary(2000, rng)
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.19 else rng.choice(rare) for _ in range(n))
    docs = [(i, prose(rng.choice([60, 100, 200, 500])), "en") for i in range(200)]
    docs += [(1000 + i, " ".join(rng.choice(rare) for _ in range(200 + 40 * i)), "en") for i in range(10)]
    kept = {r.id: r.kept for r in V.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert not any(kept[1000 + i] for i in range(10)) and sum(kept[i] for i in range(200)) >= 198


# classifier


def labelled(n=400):
    rng = random.Random(3)
    docs = []
    for i in range(n):
        bad = i % 5 == 0 if i % 3 else i % 2 == 0
        text = " ".join("###" if bad and rng.random() < 0.5 else rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(5, 60)))
        docs.append((i, text, "en" if i % 2 else "de", f"s{i % 3}", int(not bad)))
    return docs


def test_quality_on_held_out_labels(spark):
    docs = labelled()
    df = spark.createDataFrame([d[:4] for d in docs], DOCS)
    labels = spark.createDataFrame([(d[0], d[4]) for d in docs if d[0] % 2], "id long, good int")
    got = {r.doc_id: r.quality for r in Q.with_quality(df, labels).collect()}
    right = [(got[d[0]] >= 0.5) == bool(d[4]) for d in docs if d[0] % 2 == 0]
    assert np.mean(right) > 0.95


def test_sparse_sites_are_shrunk(spark):
    rows = [("big", "p", 0)] * 90 + [("big", "p", 1)] * 10 + [("mid", "p", 1)] * 60 + [("mid", "p", 0)] * 5 + [("one", "p", 0), ("none", "p", None)]
    got = {r.host: r.site_odds for r in Q.site_rates(spark.createDataFrame(rows, "host string, path string, good int")).collect()}
    assert got["big"] < got["one"] < got["none"] < got["mid"]
    assert Q.site_rates(spark.createDataFrame([], "host string, path string, good int")).count() == 0


def plain_quality(docs, labels, buckets):
    """(evidence, site_odds) of each document from the definitions, a text at a time. docs: (id, text, path,
    host); labels: {id: good}; buckets: {word: bucket}."""
    spaces, marks = set(b" \t\n\x0b\x0c\r"), set(b".,;:'\"()-?")

    def numbers(text):
        raw, w = (text or "").encode(), [x.encode() for x in helpers.words(text)]
        share = lambda f: sum(map(f, raw)) / max(1, len(raw))
        of = lambda f: sum(map(f, w)) / max(1, len(w))
        folded = [helpers.fold(x.decode()) for x in w]
        other = lambda c: not (97 <= c < 123 or c >= 128 or 65 <= c < 91 or 48 <= c < 58 or c in spaces or c in marks)
        distinct = len(set(folded)) / max(1, len(w))
        repeats = sum(x == y for x, y in zip(folded, folded[1:], strict=False)) / max(1, len(w))
        return [
            share(lambda c: 97 <= c < 123 or c >= 128), share(lambda c: 65 <= c < 91), share(lambda c: 48 <= c < 58), share(lambda c: c in marks), share(other),
            min(20, of(len)), of(lambda x: len(x) > 20), repeats, of(lambda x: len(x) == 1), distinct, np.log1p(len(w)), distinct * np.log1p(len(w)),
        ], {buckets[x] for x in folded}

    made = {i: numbers(t) for i, t, _, _ in docs}

    def ratios(ids):
        kinds = [[i for i in ids if labels[i] == k] for k in (1, 0)]
        of = lambda b, k: np.log((sum(b in made[i][1] for i in kinds[k]) + 1) / (len(kinds[k]) + 2))
        return {b: of(b, 0) - of(b, 1) for b in set(buckets.values())}

    known = [i for i, *_ in docs if i in labels]
    halves = [ratios([i for i in known if i % 2 != h]) for h in (0, 1)]
    mean = lambda r, i: np.mean([r[b] for b in made[i][1]]) if made[i][1] else 0.0
    x = np.array([[*made[i][0], mean(halves[i % 2], i)] for i in known])
    y = np.array([labels[i] for i in known])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z, w = np.column_stack([np.ones(len(x)), (x - centre) / scale]), np.zeros(14)
    pull = np.array([1e-6] + [1.0] * 13)
    for _ in range(200):  # damped Newton steps
        p = 1 / (1 + np.exp(-z @ w))
        w += 0.5 * np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pull), z.T @ (y - p) - pull * w)
    whole = ratios(known)
    said = {i: float(w[0] + ((np.array([*made[i][0], mean(whole, i)]) - centre) / scale) @ w[1:]) for i in made}

    def strength(level):
        level = [(k, n) for k, n in level if n]
        n, m = sum(n for _, n in level), len(level)
        if not n:
            return Q.STRENGTHS[1]
        rate = sum(k for k, _ in level) / n
        spread = sum(k * k / n for k, n in level) / n - rate**2 - rate * (1 - rate) * m / n
        return max(Q.STRENGTHS[0], min(Q.STRENGTHS[1], rate * (1 - rate) / spread - 1)) if spread > 0 else Q.STRENGTHS[1]

    count = lambda own: (sum(labels.get(i, 0) for i in own), sum(i in labels for i in own))
    hosts, paths = {}, {}
    for i, _, path, host in docs:
        hosts.setdefault(host, []).append(i)
        paths.setdefault((host, path), []).append(i)
    k, n = count([i for i, *_ in docs])
    overall = (k + 1) / (n + 2)
    s, t = strength([count(v) for v in hosts.values()]), strength([count(v) for v in paths.values()])
    logit = lambda p: np.log(p / (1 - p))
    odds = {}
    for i, _, path, host in docs:
        (k, n), (a, b) = count(hosts[host]), count(paths[host, path])
        odds[i] = logit((a + t * (k + s * overall) / (n + s)) / (b + t)) - logit(overall)
    return said, odds


def test_quality_is_what_its_definition_says(spark):
    docs = [d[:4] for d in labelled(150)] + [(1000, None, "en", None), (1001, "", None, "s1"), (1002, "Alpha epsilon zeta, (Beta)!" * 3, "de", "s9")]
    labels = {d[0]: d[4] for d in labelled(150) if d[0] % 3}
    kinds = sorted({helpers.fold(x) for _, t, _, _ in docs for x in helpers.words(t)})
    raw = " ".join(kinds).encode()
    hashed = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash
    said, odds = plain_quality(docs, labels, {x: int(h % np.uint64(Q.BUCKETS)) for x, h in zip(kinds, hashed, strict=True)})
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("own") for c in ("quality", "Evidence", "site_odds", "host", "path", "n")}).repartition(3)
    got = Q.with_quality(df, spark.createDataFrame(list(labels.items()), "id long, good int"))
    assert got.columns == [*df.columns, "evidence_", "site_odds_", "quality_"]
    rows = [r.asDict() for r in got.collect()]
    assert {(r["quality"], r["Evidence"], r["site_odds"]) for r in rows} == {("own",) * 3}
    for r in rows:
        i = r["doc_id"]
        want = (said[i], odds[i], 1 / (1 + np.exp(-said[i] - odds[i])))
        assert np.allclose((r["evidence_"], r["site_odds_"], r["quality_"]), want, atol=1e-6)
    kept = Q.good_documents(df, spark.createDataFrame(list(labels.items()), "id long, good int"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in said if said[i] + odds[i] >= 0)


def test_words_tell_good_texts_from_bad(spark):
    """Texts alike in all counts, told apart by their words."""
    rng = random.Random(6)
    bad, good = ["casino", "jackpot", "winner"], ["garden", "evening", "letter"]
    docs = []
    for i in range(600):
        own = bad if i % 4 == 0 else good
        docs.append((i, " ".join(rng.choice(own) if rng.random() < 0.3 else rng.choice(["house", "river", "stone", "music"]) for _ in range(40)), "en", "s0"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, *_ in docs if i % 3 == 0], "id long, good int")
    got = {r.doc_id: r.quality for r in Q.with_quality(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 != 0) for i in got if i % 3]) > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (6, None)], "id long, good int")
    got = Q.with_quality(odd(spark), labels)
    assert got.count() == len(helpers.ODD) and got.where("quality is null or isnan(quality)").count() == 0
    assert Q.good_documents(odd(spark), labels).columns == odd(spark).columns
    assert Q.with_quality(odd(spark).limit(0), labels).count() == 0 and Q.with_quality(odd(spark), labels.limit(0)).count() == len(helpers.ODD)


# reputation


def test_url_parts_and_rules(spark):
    urls = [None, "no scheme", "http://A.Org/x?y", "https://Sub.example.ORG/es/1#z", "http://example.org/en/12", "http://notexample.org/es/", "x://y.com", "http://u.com/de/a://b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = [tuple(r)[1:5] for r in R.judged(df, spark.createDataFrame([], "id long, bad int"), rules).orderBy("id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.org", "/x", "org/", "allow"), ("sub.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/", "org/", "allow"), ("y.com", "", None, "allow"), ("u.com", "/de/a://b", "com/de/", "block"),
    ]


def test_hosts_borrow_from_their_domain(spark):
    rows = [("a.bad.com", 1)] * 40 + [("b.bad.com", 1)] * 30 + [("c.bad.com", None)] + [("x.good.co.uk", 0)] * 60 + [("y.good.co.uk", 0)] * 50 + [("new.org", None)]
    got = {r.host: r for r in R.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.com"].bound > R.MOST_BAD > got["x.good.co.uk"].posterior
    assert got["c.bad.com"].posterior > got["new.org"].posterior > got["x.good.co.uk"].posterior
    one = spark.createDataFrame([("a.co.uk", "b")], "h string, x string")
    assert one.select(R.domain_of(F.lit("x.y.co.uk")), R.suffix_of(F.lit("x.y.co.uk")), R.domain_of(F.lit("y.com")), R.domain_of(F.lit("host"))).first()[:] == ("y.co.uk", "co.uk", "y.com", "host")


def test_filter_on_held_out_pages(spark):
    """Half of the pages are labelled; of the other half the method blocks those of bad domains (good pages
    on them too, a host being judged as a whole) and leaves those of good ones. Suffixes are given."""
    rng = random.Random(17)
    rates = {f"d{i}.co.zz": rng.choice([0.01, 0.03, 0.8, 0.95]) for i in range(60)}
    pages, bad = [], {}
    for domain, rate in rates.items():
        for _ in range(rng.choice([15, 60])):
            bad[len(pages)] = int(rng.random() < rate)
            pages.append((len(pages), f"http://{rng.choice(['www', 'm', 'a', 'b'])}.{domain}/x"))
    outcomes = spark.createDataFrame([(i, b) for i, b in bad.items() if i % 2], "id long, bad int")
    rows = R.judged(spark.createDataFrame(pages, "page_id long, url string"), outcomes, [], suffixes=["co.zz"]).collect()
    held = [(rates[r.host.split(".", 1)[1]] > 0.5, r.verdict == "block") for r in rows if r.id % 2 == 0]
    caught, lost = ([v for b, v in held if b == k] for k in (True, False))
    assert len(rows) == len(pages) and np.mean(caught) > 0.85 and np.mean(lost) < 0.02


# secrets


@pytest.fixture(scope="module")
def forest(spark):
    return S.train(S.labelled_findings(spark))


def test_forest_on_held_out_findings(spark, forest):
    rows = S.labelled_findings(spark, 8000).withColumn("n", F.monotonically_increasing_id()).where("n >= 4000")
    voted = rows.select("label", S.vote(forest, S.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), F.col("assigned"))).alias("p"))
    got = voted.groupBy().agg(F.avg((F.col("p") > 0.5).cast("double") * F.col("label")).alias("hit"), F.avg((F.col("p") > 0.5).cast("double") * (1 - F.col("label"))).alias("false")).first()
    assert got.hit > 0.46 and got.false < 0.01


def test_findings_and_redaction(spark, forest):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    docs = [(101, f'the token = "{key}" and {key} again', "en", "src0"), (102, f"commit {key} of today", "en", "src0"), (103, "config_value_index_table_12 is fine", "en", "tests/unit"), *helpers.ODD]
    df = spark.createDataFrame(docs, DOCS).withColumn("n_chars", F.length("text").cast("long")).withColumn("findings_", F.lit(1))
    found = {(r.doc_id, r.f.value): r.f for r in S.with_findings(df, forest).select("doc_id", F.explode("findings").alias("f")).collect()}
    assert found[101, key].is_secret and found[101, key].times == 2 and found[101, key].start == 14 and not found[102, key].is_secret
    assert not any(f.is_secret for (i, _), f in found.items() if i != 101)
    out = {r.doc_id: r for r in S.redacted(df, forest, length_col="n_chars").collect()}
    assert out[101].text == 'the token = "[SECRET]" and [SECRET] again' and out[101].n_chars == len(out[101].text)
    assert S.redacted(df, forest).schema == df.schema and S.redacted(df, forest).where("doc_id <> 101 or doc_id is null").exceptAll(df).count() == 0
    assert S.with_findings(df.limit(0), forest).count() == 0


def test_native_plans_hold_no_python(spark, forest):
    df = spark.createDataFrame([r for r in helpers.ODD], DOCS)
    for frame in (S.with_findings(df, forest), V.base_counts(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# mixing


def flowed(blocks, weights, slots):
    """The blocks of each source that an ideal mix has passed after so many slots, as fractions."""
    left = {i: Fraction(b) for i, b in enumerate(blocks)}
    rest = Fraction(slots)
    while rest > 0 and any(left.values()):
        live = {i: Fraction(weights[i]) for i in left if left[i]}
        total = sum(live.values())
        step = min(rest, *(left[i] * total / w for i, w in live.items()))
        for i, w in live.items():
            left[i] -= step * w / total
        rest -= step
    return [b - left[i] for i, b in enumerate(blocks)]


def scheduled(blocks, weights):
    """A slot at a time: windows searched in the ideal mix, the earliest due of the released blocks taken."""
    ideal = [flowed(blocks, weights, t) for t in range(sum(blocks) + 1)]
    done, out = [0] * len(blocks), []
    for t in range(sum(blocks)):
        free = []
        for i, b in enumerate(blocks):
            # its next block is released if more than those done flow by the end of this slot
            if done[i] < b and ideal[t + 1][i] > done[i]:
                free.append((next(u for u, x in enumerate(ideal) if x[i] >= done[i] + 1), i))
        out.append(min(free)[1])
        done[out[-1]] += 1
    return out


MIXES = [
    ([5], [1.0]), ([7, 7], [1.0, 1.0]), ([30, 10], [3.0, 1.0]), ([20, 20, 2, 9], [0.7, 0.1, 0.1, 0.1]), ([4, 4, 4, 30], [1 / 3, 1 / 3, 1 / 3, 5.0]),
    ([1, 2, 3, 4, 5, 6, 7], [1e-6, 1e-3, 1.0, 1.0, 2.0, 7.0, 1e3]), ([12, 0 + 1, 12], [0.1, 0.2, 0.3]),
]


@pytest.mark.parametrize("blocks, weights", MIXES)
def test_schedule_is_that_of_a_plain_simulation(blocks, weights):
    assert M.schedule(blocks, weights).tolist() == scheduled(blocks, weights)


@pytest.mark.parametrize("n, spread, total", [(10_000, 6, 60_000), (500, 6, 30_000), (3, 0, 9_000), (40, 12, 20_000)])
def test_every_source_is_within_a_block_of_its_target(n, spread, total):
    """Against the ideal mix of the weights themselves, at every slot; one heavy source besides."""
    rng = np.random.default_rng(n)
    weights = 10.0 ** rng.uniform(-spread, 0, n)
    weights[0] = weights.sum()
    blocks = np.maximum(1, (rng.dirichlet(np.ones(n)) * total)).astype(int)
    blocks[0] = total // 2
    order = M.schedule(blocks.tolist(), weights.tolist())
    assert np.array_equal(np.bincount(order, minlength=n), blocks)
    # V: what each unit of weight has passed; time as a function of it bends where a source ends
    ends = np.sort(blocks / weights)
    rank = np.argsort(blocks / weights, kind="stable")
    done, rate = np.concatenate([[0], np.cumsum(blocks[rank])])[:-1], np.cumsum(weights[rank][::-1])[::-1]
    bends = done + rate * ends
    for i in [0, *rng.choice(n, min(n, 60), replace=False)]:
        own = np.flatnonzero(order == i)
        k = np.arange(len(own))
        for t, made in ((own, k), (own + 1, k + 1)):  # before and after each of its slots
            level = np.interp(t, np.concatenate([[0], bends]), np.concatenate([[0], ends]))
            assert np.abs(np.minimum(blocks[i], weights[i] * level) - made).max() < 1 + 1e-6


def test_schedule_of_nothing():
    assert M.schedule([], []).tolist() == []


def test_mix_is_the_schedule(spark, monkeypatch):
    """Weights given, among them for the null source; and columns of the added names."""
    monkeypatch.setattr(M, "BUCKET", 50)
    rows = [(i, f"s{0 if i % 3 == 0 else i % 7}") for i in range(900)] + [(5000 + i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({c: F.lit("own") for c in ("block", "Slot", "place", "key", "row", "rank")}).repartition(7)
    names = [*(f"s{i}" for i in range(7)), None]
    weights = {x: 0.5 + i for i, x in enumerate(names)}
    out = [dict(zip((*df.columns, "block_", "slot_", "place_"), r, strict=True)) for r in M.mixed(df, block=8, weights=weights).collect()]
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    assert {r["block"] for r in out} == {r["Slot"] for r in out} == {r["rank"] for r in out} == {"own"}
    assert len({(r["slot_"], r["place_"]) for r in out}) == len(out)
    slots = {}
    for r in out:
        assert slots.setdefault(r["slot_"], (r["source"], r["block_"])) == (r["source"], r["block_"])
    assert sorted(slots) == list(range(len(slots)))
    size = {s: sum(r[1] == s for r in rows) for s in names}
    want = scheduled([-(-size[x] // 8) for x in names], [weights[x] for x in names])
    assert [slots[t][0] for t in range(len(slots))] == [names[i] for i in want]
    for s in names:
        own = [b for t, (x, b) in sorted(slots.items()) if x == s]
        assert own == list(range(len(own)))


def test_many_rows_make_larger_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("source"))
    out = M.mixed(df, block=2, slots=50).collect()
    assert {max(r.place for r in out if r.source == s) for s in range(3)} == {19}
    assert max(r.slot for r in out) == 50


def test_mix_of_odd_rows(spark):
    out = M.mixed(odd(spark))
    assert out.count() == len(helpers.ODD) and out.columns[: len(odd(spark).columns)] == odd(spark).columns
    assert M.mixed(odd(spark).limit(0)).count() == 0
    with pytest.raises(ValueError, match="weight"):
        M.mixed(odd(spark), weights={"src0": 1.0})


def test_walk_keys_do_not_hang_on_place():
    raw = b"zz yy one two three four five six seven eight nine ten"
    found = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), PLAIN)
    h = found.hash
    a, _ = D._walk(h, np.array([0]), np.array([len(h)]), np.array([2]), 0, 1, 1)
    b, _ = D._walk(h[2:], np.array([0]), np.array([len(h) - 2]), np.array([0]), 0, 1, 1)
    assert a == b
