"""Operator 2 against brute force."""

import random

import numpy as np
import xxhash

from sitelens.llm import simhash as S
from sitelens.llm.components import connected_components


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """doc_id -> (fingerprint, smallest id reachable)."""
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def planted(seed=1):
    """Fingerprints with near ones and one large group."""
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(200)}
    for f in list(out):
        for _ in range(rnd.randint(0, 3)):
            out.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6))))
    hot = rnd.getrandbits(64)
    out |= {hot ^ sum(1 << b for b in rnd.sample(range(20), rnd.randint(1, 5))) for _ in range(300)}
    return np.array(sorted(out), np.uint64)


def test_fingerprints_with_words_of_every_number():
    rnd = random.Random(0)
    for n in range(30):
        text = rnd.choice(["", " "]) + "\t ".join(rnd.choice(["A", "bÉ", "cc", "d\x1c"]) for _ in range(n))
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_kernels_find_exactly_the_close_pairs():
    fp = planted()
    close = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    want = {tuple(p) for p in close.tolist()}
    got = {(a, b) for q, r in S.block_links(fp, fp, 4) for a, b in zip(q.tolist(), r.tolist()) if a < b}
    assert got == want
    group = np.arange(len(fp)) // 20
    a, b = S.small_links(fp, group, 4)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if group[i] == group[j]}


def test_every_close_pair_shares_a_block_choice():
    for n in (10, 10**7, 10**9):
        m = S.blocks_for(n, 4)
        masks = [x % (1 << 64) for x in S.block_masks(m, 4)]
        rnd = random.Random(n)
        for _ in range(300):
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(flips & mask == 0 for mask in masks)


def test_links_and_components_also_with_split_groups(spark):
    fp = planted(2)
    close = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    label = S.smallest_linked(len(fp), [(close[:, 0], close[:, 1])])
    signed = fp.view(np.int64)
    groups: dict = {}
    for i, g in enumerate(label.tolist()):
        groups.setdefault(g, set()).add(int(signed[i]))
    want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    for block in (S.BLOCK, 40):
        found: dict = {}
        for r in connected_components(S.links(df, 4, block)).collect():
            found.setdefault(r.root, set()).add(r.node)
        assert sorted(sorted(g) for g in found.values()) == want
        assert all(min(g) == root for root, g in found.items())


def test_chain_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def test_documents_equal_brute_force(llm_docs):
    rows, df = llm_docs
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_edge_rows(edge_docs, no_docs):
    got = S.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {1, 2, 3, None} and {r.component_id for r in empty} == {1}
    alone = [r for r in got if r.doc_id is None and r.fingerprint != "0" * 16]
    assert [r.component_id for r in alone] == [None]
    assert S.near_duplicates(no_docs).count() == 0
