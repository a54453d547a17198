"""Operator 9 against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np

from sitelens.llm import quality as Q


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_counts():
    rnd = random.Random(2)
    parts = ["a", "b", "é", "the", " ", " ", "\n", "\n", "\t", "#", "x|y", "\x0b", " ", "\x1c", "日"]
    for _ in range(600):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        assert Q.base_counts(text, Q.words_of(text)) == brute_counts(text), repr(text)


def labelled(size=300):
    rnd = random.Random(4)
    good, poor = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"], [f"{a}%%{b}" for a in "abc" for b in "xyz"]
    docs, labels = [], []
    for i in range(size):
        ok = rnd.random() < 0.8
        docs.append((i, " ".join(rnd.choice(good if ok or rnd.random() < 0.2 else poor) for _ in range(rnd.randint(5, 50)))))
        if rnd.random() < 0.5:
            labels.append((i, int(ok), 0))
    return docs, labels


def test_scores_and_verdicts_equal_brute_force(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bits = 12
    got = {r.doc_id: r for r in Q.quality_rules(d, l, bits=bits).collect()}
    folds = {r.doc_id: r for r in Q.labelled_sample(l, 10**6).collect()}
    raw, target = Counter(), Counter()
    for i, text in docs:
        grams = Q.buckets(Q.words_of(text), bits).tolist()
        raw.update(grams)
        if i in folds and folds[i].good and folds[i].fold > 0:
            target.update(grams)
    size, n_raw, n_target = 1 << bits, sum(raw.values()), sum(target.values())
    ratio = {
        b: math.log((target[b] + 0.5) / (n_target + 0.5 * size)) - math.log((raw[b] + 0.5) / (n_raw + 0.5 * size)) for b in raw
    }
    score = {}
    for i, text in docs:
        grams = Q.buckets(Q.words_of(text), bits).tolist()
        score[i] = sum(ratio[b] for b in grams) / len(grams)
        assert abs(got[i].score - score[i]) < 1e-5
    held = [i for i in folds if folds[i].fold == 0]
    cut = Q.best_threshold(np.array([got[i].score for i in held]), np.array([folds[i].good for i in held]))
    for i, text in docs:
        c = brute_counts(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == c
        assert got[i].base_failed == failed and got[i].kept == (not failed and got[i].score >= cut)
    truth = {i: q for i, q, _ in labels}
    assert not any(got[i].base_failed is False and not got[i].kept for i, q in truth.items() if q == 1)


def test_threshold():
    s, g = np.array([0.1, 0.2, 0.3, 0.4]), np.array([False, False, True, True])
    assert 0.2 < Q.best_threshold(s, g) < 0.3
    assert Q.best_threshold(s, np.ones(4, bool)) == float("-inf")
    assert Q.best_threshold(np.zeros(0), np.zeros(0, bool)) == float("-inf")


def test_edge_rows(edge_docs, no_docs, few_labels):
    got = Q.quality_rules(edge_docs, few_labels).collect()
    assert len(got) == edge_docs.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 5, 6))
    without = Q.quality_rules(edge_docs, few_labels.filter("false")).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in without)
    assert Q.quality_rules(no_docs, few_labels).count() == 0


def test_every_trusted_document_is_counted(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs + [(0, docs[0][1]), (None, "abc")], "doc_id long, text string").repartition(4)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = lambda **options: sorted((str(r.doc_id), r.score) for r in Q.quality_rules(d, l, bits=12, **options).collect())
    want = score()
    assert score(max_labelled=8) == want
    assert score(broadcast_ids=0) == want
    sample = Q.labelled_sample(l, 8).collect()
    assert sum(r.fold == 0 for r in sample) < 20 < sum(r.fold > 0 for r in sample) == sum(
        r.fold > 0 for r in Q.labelled_sample(l, 10**6).collect()
    )


def test_threshold_of_a_table(spark):
    rnd = random.Random(9)
    for size, spread in ((0, 5), (1, 5), (40, 3), (60, 10**6), (400, 30), (400, 10**6)):
        rows = [(round(rnd.gauss(0, 1) * spread) / spread, rnd.random() < 0.5) for _ in range(size)]
        rows = [(s + (0.5 if g else 0.0), g) for s, g in rows]
        table = spark.createDataFrame(rows, "score double, good boolean").repartition(5)
        s, g = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], bool)
        for cost in (0.5, 1.0, 8.0):
            assert Q.exact_threshold(table, cost) == Q.best_threshold(s, g, cost)
    assert Q.exact_threshold(spark.createDataFrame([(0.5, True)], "score double, good boolean")) == float("-inf")


def test_every_held_out_document_counts_for_the_threshold(spark, monkeypatch):
    docs, labels = labelled()
    d = spark.createDataFrame(docs + [(docs[0][0], "repeated id"), (None, "abc")], "doc_id long, text string").repartition(4)
    # Far more labels than documents: a bounded share of them would lose documents.
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").union(
        spark.range(10**6, 10**6 + 900_000).selectExpr("id", "cast(id % 2 as int)", "0"))
    seen = []
    monkeypatch.setattr(Q, "exact_threshold", lambda scores: seen.append(sorted(map(tuple, scores.collect()))) or 0.0, raising=False)
    monkeypatch.setattr(Q, "best_threshold", lambda s, g: seen.append(sorted(zip(s.tolist(), g.tolist()))) or 0.0)
    for options in ({}, {"broadcast_ids": 0}):
        Q.fit(d, l, bits=12, **options)
    held = {r.doc_id for r in Q.labelled_sample(l, 10**9).filter("fold = 0 AND doc_id < 1000").collect()}
    rows = sum(i in held for i, _ in docs + [docs[0]])
    assert seen[0] == seen[1] and len(seen[0]) == rows
