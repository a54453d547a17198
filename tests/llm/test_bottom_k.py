"""Operator 12 against brute-force Jaccard components."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sitelens.llm import bottom_k as B

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, shingle=2, percent=80):
    """[(doc_id, n_shingles, component_id, kept)], all pairs compared; rows with their own number as a node."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def near_copies(seed, groups=6, copies=12, words=400):
    """Long texts, copies with some words changed, chains of copies of copies."""
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        text = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        for _ in range(copies):
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
            changed = list(text)
            for _ in range(rnd.randrange(words // 12)):
                changed[rnd.randrange(words)] = f"w{rnd.randrange(3000)}"
            if g % 2:
                text = changed
            rows.append((len(rows) * 7 % 1009, " ".join(changed)))
    return rows


def test_long_near_copies(spark):
    rows = near_copies(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert 6 <= len({r[2] for r in want}) < len(rows) / 2
    assert got(B.near_duplicates(df, shingle=2)) == want


def test_short_texts_of_few_words(llm_docs):
    rows, df = llm_docs
    assert got(B.near_duplicates(df, shingle=2)) == brute(rows)


def test_blocks_equal_brute_force(spark, llm_docs, monkeypatch):
    """All candidate pairs from small blocks of the lists, without leaders."""
    rows, df = llm_docs
    monkeypatch.setattr(B, "BLOCK", 8)
    own = df.select("doc_id", "text")
    found = B.sketches(own, 2, 64).filter("key IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    found = B.materialize(found.withColumn("sid", F.monotonically_increasing_id()), "test-classes")
    name = {r.sid: bytes(r.key) for r in found.collect()}
    lists = B._open_lists(B.materialize(B.postings_of(found, 64, 80).withColumn("root", F.col("sid")), "test-lists"), 0).drop("lead")
    pairs = {frozenset((name[r.a], name[r.b])) for r in B._block_pairs(lists, found, 64, 80).collect()}
    full = {bytes(B.set_key(v)): set(v.tolist()) for v in (B.shingle_set(t, 2) for _, t in rows) if len(v)}
    keys = list(full)
    links = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])}
    assert links and links <= pairs and len(pairs) < 5 * len(links) + 50
    assert set(keys) == set(name.values())


def test_bounds_hold_for_similar_sets():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        n = int(rnd.integers(1, 400))
        both = rnd.permutation(np.unique(rnd.integers(-2**62, 2**62, n)))
        drop = int(0.2 * n)
        a, b = np.sort(both[int(rnd.integers(0, drop + 1)):]), np.sort(both[: n - drop // 2])
        same = len(np.intersect1d(a, b))
        if 100 * same < 80 * (len(a) + len(b) - same):
            continue
        shared = len(np.intersect1d(a[:64], b[:64]))
        assert shared >= B.least_shared(np.array([len(a)]), 64, 80)[0] and shared >= B.least_shared(np.array([len(b)]), 64, 80)[0]
        assert B.union_estimate(a[:64], b[:64], len(a), len(b), 64, 80)


def test_least_shared_column_equals_numbers(spark):
    rows = spark.range(1, 500).select("id", B.least_shared(F.col("id"), 64, 80).alias("c")).collect()
    assert [r.c for r in rows] == B.least_shared(np.arange(1, 500), 64, 80).tolist()
    assert B.chernoff_count(64, 80) == 23


def test_blocks_send_members_not_all_their_pairs(spark, monkeypatch):
    """A large group whose texts are like a hub and less like each other: the
    sketches of nearly all pairs pass, their full sets do not."""
    rnd = random.Random(6)
    hub = [f"w{rnd.randrange(3000)}" for _ in range(400)]
    rows = []
    for i in range(300):
        text = list(hub)
        for at in rnd.sample(range(400), 30 if i % 3 else 50):
            text[at] = f"x{rnd.randrange(300)}"
        rows.append((i * 7, " ".join(text)))
    rows.append((9000, " ".join(hub)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent = []
    compared = B._block_pairs

    def counted(lists, sets, k, percent, *read):
        out = compared(lists, sets, k, percent, *read)
        entries = lists.select("sid").distinct().count()
        sent.append((out.count(), entries))
        return out

    monkeypatch.setattr(B, "_block_pairs", counted)
    assert got(B.near_duplicates(df, shingle=2)) == brute(rows)
    assert sent and all(pairs <= entries for pairs, entries in sent)


def test_full_sets_decide_in_blocks_of_many_pairs(spark, monkeypatch):
    """Without leaders all links come from the blocks, also from small ones."""
    rows = near_copies(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(B, "LEADER_TURNS", 0)
    want = brute(rows)
    assert got(B.near_duplicates(df, shingle=2)) == want
    monkeypatch.setattr(B, "BLOCK", 5)
    monkeypatch.setattr(B, "FEW", 2)
    monkeypatch.setattr(B, "COLUMNS", 7)
    assert got(B.near_duplicates(df, shingle=2)) == want


def test_shared_counts_of_a_block():
    rnd = np.random.default_rng(5)
    parts = [np.unique(rnd.integers(0, 300, int(rnd.integers(1, 80)))) for _ in range(90)]
    rows = np.flatnonzero(rnd.random(90) < 0.4)
    want = [[len(np.intersect1d(parts[x], p)) for p in parts] for x in rows]
    got = B._shared(parts, rows)
    off = rows[:, None] != np.arange(90)
    assert (got[off] == np.array(want)[off]).all()


def test_least_shared_is_never_above_the_law_of_the_union():
    """Draws without replacement: exact tails, by integers."""
    from math import comb

    for n in (30, 64, 65, 90, 130, 250, 600):
        c = B.shared_table(64, 80)[n]
        assert c >= min(B.chernoff_count(64, 80), -(-80 * n // 100))
        for size in range(n, n * 100 // 80 + 1):
            both, draws = -(-80 * size // 100), min(64, size)
            fewer = sum(comb(both, x) * comb(size - both, draws - x) for x in range(c) if draws - x <= size - both)
            assert fewer * 10**12 <= comb(size, draws) * 1.000001


def test_edge_rows(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert got(B.near_duplicates(edge_docs, shingle=2)) == brute(rows)
    assert B.near_duplicates(no_docs).count() == 0


def test_a_pair_leaves_the_blocks_of_one_list_only(spark, monkeypatch):
    """Near copies share many lists; without leaders all their pairs come from blocks."""
    rows = near_copies(4, groups=1, copies=60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(B, "LEADER_TURNS", 0)
    sent = []
    compared = B._compare_blocks

    def counted(*args, **options):
        out = B.materialize(compared(*args, **options), "test-blocks")
        pairs = out.filter("b IS NOT NULL")
        sent.append((pairs.count(), pairs.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(B, "_compare_blocks", counted)
    assert got(B.near_duplicates(df, shingle=2)) == brute(rows)
    assert sum(n for n, _ in sent) and all(n == distinct for n, distinct in sent)


def test_estimate_of_some_bits_loses_no_pair_of_whole_values():
    rnd = np.random.default_rng(8)
    for _ in range(300):
        n = int(rnd.integers(1, 400))
        both = rnd.permutation(np.unique(rnd.integers(-2**62, 2**62, n)))
        a, b = np.sort(both[int(rnd.integers(0, n // 2 + 1)):]), np.sort(both[:n - int(rnd.integers(0, n // 2 + 1))])
        x, y = a[:64], b[:64]
        union = np.union1d(x, y)[:64]
        shared = len(np.intersect1d(np.intersect1d(x, y), union))
        if max(len(a), len(b)) > 64:
            want = shared >= max(B.least_shared(np.array([len(a), len(b)]), 64, 80))
        else:
            want = 100 * shared >= 80 * (len(a) + len(b) - shared)
        assert B.union_estimate(x, y, len(a), len(b), 64, 80) == want
        assert B.union_estimate(x & 32767, y & 32767, len(a), len(b), 64, 80) >= want


def test_read_stage_tables_are_deleted(spark, llm_docs):
    import glob

    from sitelens.session import stage_folder

    folder = stage_folder(spark).removeprefix("file:")
    before = {*glob.glob(f"{folder}/*")}
    assert B.near_duplicates(llm_docs[1], shingle=2).count()
    names = {p.rsplit("/", 1)[1].rpartition("-")[0][:9] for p in {*glob.glob(f"{folder}/*")} - before}
    assert names and not [n for n in names if n.startswith(("bottom-k", "full-sets"))]
