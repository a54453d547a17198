"""Operator 1 against brute force."""

import random
import re

from sitelens.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower().decode())


def brute(docs, items, window=13):
    """List of (doc_id, n_words, n_hit, item ids, contaminated)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                ids = windows.get(tuple(w[s:s + size]))
                if ids:
                    found |= ids
                    hit.update(range(s, s + size))
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), listed, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in df.collect()), key=repr)


def planted():
    rnd = random.Random(7)
    vocabulary = "a B ccc dé 12 éa Zz ö the of x".split()
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rnd.choice([1, 2, 3, 5, 7, 12, 13, 14, 20, 30])) if i > 3 else make(15 + i))) for i in range(14)]
    items = [x for x in items if len(words(x[1])) not in (1, 2)] + [(50, "Unique"), (51, "pair Ö!pair")]
    docs = []
    for i in range(120):
        w = make(rnd.randint(0, 60))
        if rnd.random() < 0.6:
            item = words(rnd.choice(items)[1])
            at = rnd.randrange(len(w) + 1)
            cut = item if rnd.random() < 0.6 else item[: rnd.randrange(len(item) + 1)]
            w[at:at] = cut
        docs.append((i, rnd.choice([" ", "-", ", "]).join(w)))
    return docs, items


def test_equals_brute_force_by_both_join_forms(spark):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(r[2] > 0 for r in want) > 20
    assert result(decontaminate(d, b)) == want
    assert result(decontaminate(d, b, broadcast_rows=0)) == want


def test_edge_rows(edge_docs, no_docs, few_items):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in few_items.select("item_id", "text").collect()]
    want = brute(rows, items)
    assert result(decontaminate(edge_docs, few_items)) == want
    assert result(decontaminate(edge_docs, few_items, broadcast_rows=0)) == want
    assert any(r[2] and not r[3] for r in want)  # a hit of the item without an id
    assert decontaminate(no_docs, few_items).count() == 0
    assert not any(r[4] for r in result(decontaminate(edge_docs, few_items.filter("false"))))
