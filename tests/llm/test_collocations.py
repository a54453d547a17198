"""Operator 11 against a brute-force count of all phrases."""

import random
import re
from collections import Counter

from sitelens.llm import collocations as C

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, max_words=4, min_count=30, top=2000, absorb=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i:i + m]) for m in range(1, max_words + 1) for i in range(len(w) - m + 1))
    cands = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    inside = Counter()
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i:i + m]] = max(inside[lang, w[i:i + m]], a)
    out = []
    for (lang, w), a in cands.items():
        if 100 * inside[lang, w] >= absorb * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    result, rank = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(result)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed, size):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "日本", "X-1", "a'b"]
    fixed = ["alpha Beta", "alpha beta gamma", "one two three four", "one two three four five", "the the the"]
    rows = []
    for _ in range(size):
        parts = [rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(words) for _ in range(rnd.randrange(30))]
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), "".join(p + rnd.choice("   \t.\n,;\x0b") for p in parts)))
    return rows


def test_equals_brute_force(spark):
    rows = made(5, 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert len(brute(rows, min_count=5)) > 50
    assert got(C.collocations(df, min_count=5)) == brute(rows, min_count=5)
    assert got(C.collocations(df, min_count=3, top=7, absorb=50)) == brute(rows, min_count=3, top=7, absorb=50)
    assert got(C.collocations(df, max_words=2, min_count=30)) == brute(rows, max_words=2, min_count=30)


def test_small_task_tables(spark):
    """Tasks that hand on their counts early give the same sums."""
    rows = made(6, 60)
    assert got(C.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=4, task_words=1)) == brute(rows, min_count=4)


def test_pieces_and_repeats():
    rows = [("en", "New York. new york, new york new york")] * 2
    words = C.Words()
    words.add("New York. new\tyork\r\nx")
    assert list(words) == [b"new", b"york", b"x"] and words.text.tolist() == [1, 2, 0, 1, 2, 0, 3, 0]
    assert [r[2:6] for r in brute(rows, min_count=4)] == [("new york", 8, 8, 8)]


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.lang, r.text) for r in edge_docs.collect()]
    assert got(C.collocations(edge_docs, min_count=2)) == brute(rows, min_count=2)
    assert got(C.collocations(edge_docs)) == brute(rows)  # a long text of one word, repeated
    assert C.collocations(no_docs).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).count() == 0
