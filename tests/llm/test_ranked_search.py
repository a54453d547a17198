"""Operator 13 against a brute-force ranking."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sitelens.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=10):
    """[(item_id, rank, doc_id, score)], every document scored against every item."""
    words = [(d, terms(t)) for d, t in rows]
    n_docs, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    counted = [(d, len(w), Counter(w)) for d, w in words if w]
    out = []
    for item_id, text in set(items):
        query, scored = Counter(terms(text)), []
        for d, n, tf in counted:
            m = 25 + (75 * n * n_docs) // total
            s = sum(rep * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                    for t, rep in query.items() if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items():
    return [(1, "Lorem IPSUM dolor, dolor; è wörd"), (2, "the of 日本"), (3, "x9"), (4, "nowhere-at-all"), (5, None), (6, ""),
            (7, "qeq Shti sit amet lorem the the"), (7, "another text of the same id"), (None, "wörd amet")]


def test_equals_brute_force(spark, llm_docs, items):
    rows, df = llm_docs
    want = brute(rows, items)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert got(R.ranked_search(df, queries)) == want
    # Many shards and blocks give the same result, also with few results asked for.
    assert got(R.ranked_search(df, queries, shard_docs=7, block_items=2)) == want
    assert got(R.ranked_search(df, queries, k=2, shard_postings=30, block_bytes=20)) == brute(rows, items, k=2)


def test_ties_and_repeated_rows(spark):
    rows = [(i, "same words here") for i in (9, 3, 7, 3)] + [(None, "same words here"), (1, "other"), (2, "same same words")]
    items = [(1, "same words"), (1, "same words")]
    for k in (2, 3, 10):
        out = got(R.ranked_search(spark.createDataFrame(rows, "doc_id long, text string").repartition(3),
                                  spark.createDataFrame(items, "item_id long, text string"), k=k, shard_docs=2))
        assert out == brute(rows, items, k)


def test_edge_rows(spark, edge_docs, no_docs, few_items):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    items = [(r.item_id, r.text) for r in few_items.collect()]
    assert got(R.ranked_search(edge_docs, few_items)) == brute(rows, items)
    assert R.ranked_search(no_docs, few_items).count() == 0
    assert R.ranked_search(edge_docs, few_items.filter("false")).count() == 0
    texts = edge_docs.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert R.ranked_search(texts, few_items).schema["doc_id"].dataType.simpleString() == "string"


def test_accumulators_are_limited():
    """A common term creates no accumulators once the rare one decides, and survivors stay exact."""
    n = 400
    rows = [["common"] + ["rare"] * 5 * (i % 20 == 0) for i in range(n)]
    doc, term, tf = [], [], []
    for i, words in enumerate(rows):
        for w, c in Counter(words).items():
            doc.append(i), term.append(0 if w == "rare" else 1), tf.append(c)
    as_bytes = [np.array(a, np.int64) for a in (doc, term, tf)]
    shard = R.Shard(pa.array(range(n)), [len(w) for w in rows], *as_bytes, n, sum(map(len, rows)))
    query = [(0, R.weight(n, 20)), (1, R.weight(n, n) + 1)]
    top, scores = shard.rank(query, 10)
    assert top.tolist() == list(range(0, 200, 20))
    one, two = (10**9 * 5) // (5000 + 8 * (25 + 75 * 6 * n // 500)), 10**9 // (1000 + 8 * (25 + 75 * 6 * n // 500))
    assert scores.tolist() == [query[0][1] * one + query[1][1] * two] * 10
    assert shard.accumulators == 20
