"""Operator 10 against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from sitelens.llm import bwt_dedup as B


def brute(rows, length=50):
    first = {}
    for doc_id, data in sorted(r for r in rows if r[0] is not None):
        for p in range(len(data) - length + 1):
            first.setdefault(data[p:p + length], doc_id)
    out = []
    for doc_id, data in rows:
        covered = bytearray(len(data))
        for p in range(len(data) - length + 1 if doc_id is not None else 0):
            if first[data[p:p + length]] < doc_id:
                covered[p:p + length] = b"\1" * length
        kept = bytes(c for c, hit in zip(data, covered) if not hit)
        spans = sum(covered[p] and not (p and covered[p - 1]) for p in range(len(data)))
        out.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, **options):
    return sorted((tuple(r)[:5] for r in B.dedup_substrings(df, keep_text=False, **options).collect()), key=repr)


def test_transform_finds_exactly_the_shared_strings():
    rnd = random.Random(5)
    for _ in range(80):
        length = rnd.choice([3, 5, 8])
        letters = rnd.choice([b"ab", b"abc", bytes(range(97, 110))])
        texts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(length, 30))) for _ in range(rnd.randint(2, 12))]
        docs = np.array([rnd.randint(0, 6) for _ in texts])
        for text, doc, found in zip(texts, docs, B.shared_strings(texts, docs, length)):
            want = [
                p for p in range(len(text) - length + 1)
                if any(d < doc and text[p:p + length] in t for t, d in zip(texts, docs))
            ]
            assert want == found.tolist()


def test_equals_brute_force_also_with_hot_minimizers(llm_docs):
    rows, df = llm_docs
    want = brute([(i, t.encode()) for i, t in rows])
    assert sum(w[2] for w in want) > 10_000
    assert result(df) == want
    assert result(df, hot_rows=2, broadcast_rows=0) == want


def test_common_line_and_slices_of_long_texts(spark, monkeypatch):
    rnd = random.Random(8)
    line = "This line of more than fifty bytes is found in very many documents."
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"{word()} {line} {word()} {word()}") for i in range(400)]
    long_text = " ".join(word() for _ in range(3000))
    rows += [(1000, long_text), (1001, "x" + long_text), (999, long_text[5000:9000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute([(i, t.encode()) for i, t in rows])
    assert result(df, hot_rows=50) == want
    monkeypatch.setattr(B, "SLICE", 4096)
    monkeypatch.setattr(B, "BUFFER", 64)
    monkeypatch.setattr(B, "BATCH", 512)
    pieces = B.segment_rows(df.selectExpr("doc_id", "0L AS text_key", "text"), 50)
    assert pieces.count() > 1000


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in edge_docs.select("doc_id", "text").collect()]
    assert result(edge_docs) == brute(rows)
    kept = {r.doc_id: r for r in B.dedup_substrings(edge_docs).collect()}
    assert kept[2].kept == b"" and kept[7].removed == []
    assert B.dedup_substrings(no_docs).count() == 0


def test_same_id_is_one_document(spark):
    text = "a passage that is longer than fifty bytes and repeats in the corpus, "
    rows = [(1, text + "one"), (1, text + "two"), (2, "zero " + text), (None, text + "none")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute([(i, t.encode()) for i, t in rows])


def test_whole_texts_are_aggregated_only_if_ids_repeat(spark, llm_docs):
    """Texts with segments in question go to one join, not to a distinct before it."""
    rows, df = llm_docs

    def aggregates(docs):
        plan = B.covered_runs(docs)._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.split("\n") if "Aggregate [" in line and " text#" in line]

    assert not aggregates(df)
    assert aggregates(df.union(df.limit(3)))
    assert result(df.union(df.limit(3))) == brute([(r.doc_id, r.text.encode()) for r in df.union(df.limit(3)).collect()])


def test_settling_a_large_group_holds_two_buffers(monkeypatch):
    monkeypatch.setattr(B, "BUFFER", 1024)
    n = 40 * 1024
    digest = np.repeat(np.arange(n // 4), 4)  # four rows a digest, of documents 0 to 3
    mini = np.where(digest < n // 4 - 500, 7, 9)
    columns = mini, digest, np.tile(np.arange(4), n // 4), np.zeros(n, np.int64), B._place(np.arange(n), np.full(n, 3))
    taken = given = 0

    def batches():
        nonlocal taken
        for at in range(0, n, 256):
            taken += len(columns[0][at:at + 256])
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 256]) for c in columns], names=["mini", "digest", "doc_id", "text_key", "place"])

    found = []
    for out in B.settled_batches(batches()):
        assert taken - given <= 2 * B.BUFFER + 256
        given = taken
        found += out.to_pylist()
    covered = [r["first"] for r in found if not r["open"]]
    assert sorted(covered) == [i for i in range(n) if i % 4]
    assert {r["first"] for r in found if r["open"] and r["mini"] == 7} == {i for i in range(n) if i % 4 == 0 and mini[i] == 7}
