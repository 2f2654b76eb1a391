"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import random
from collections import Counter

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, held = [], ""
    for c in text or "":
        if c in SPACE:
            out, held = [*out, held] if held else out, ""
        else:
            held += c
    return [*out, held] if held else out


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=5):
    w = words(fold(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(docs, num=3, den=4):
    """{id: (size, least id reachable)} by comparing all pairs; docs: (id, text)."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            shared = len(s & t)
            if s and t and shared * den >= num * (len(s) + len(t) - shared):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets}


def vocabulary(n, rng):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def family_docs(seed, n=120):
    """Texts with copies, near copies, chains of small changes and passages that many share."""
    rng = random.Random(seed)
    vocab = vocabulary(300, rng)
    passage = [rng.choice(vocab) for _ in range(12)]
    text = lambda m: [rng.choice(vocab) for _ in range(m)]
    docs = []
    chain = text(60)
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            chain = list(chain)
            for _ in range(rng.choice([0, 1, 2, 3])):
                chain[rng.randrange(len(chain))] = rng.choice(vocab)
            w = chain
        elif kind < 0.7:
            w = text(rng.randrange(0, 40)) + passage + text(rng.randrange(0, 40))
        elif kind < 0.8 and docs:
            w = words(rng.choice(docs)[1])
        elif kind < 0.9:
            w = text(rng.randrange(0, 7))
        else:
            w = text(rng.randrange(50, 200))
        docs.append((i * 3 + 5, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    rng.shuffle(docs)
    return docs


def rule_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w, text = words(text), text or ""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


ODD = [
    (None, None, None, None), (1, None, "en", "src0"), (2, "", "en", None), (3, " \t\n\x0b\x0c\r ", None, "src1"), (4, "one", "en", "src0"),
    (5, "Über straße \u00a0 naïve \U0001f600 " * 30, "de", "src1"), (6, "word " * 30_000, "en", "src0"), (7, "a b c d e f\na b c d e f\nx", "en", "src0"),
    (7, "a b c d e f\na b c d e f\nx", "en", "src0"), (8, "x" * 50_000, "en", "src2"), (9, "A b C d E f\na B c D e F\nX", "fr", "src0"),
]
