"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: each shingle is hashed with XXH64 (seed 42); a bit of the
   fingerprint is set if it is set in more than half of the hashes.  Equal
   fingerprints are collapsed before anything is compared.
2. Candidates: a fingerprint is cut into ``m`` blocks of bits.  Two
   fingerprints that differ in at most ``r`` bits agree on at least ``m - r``
   whole blocks, so grouping by every choice of ``m - r`` blocks finds every
   such pair.  ``m`` follows from the number of distinct fingerprints (group
   keys get at least as many bits as that number), which only moves work, not
   results.
3. Comparison: the rows of a group are stored as vertical bit planes.  XORed
   planes are added into carry-save counters, 64 distances per machine word,
   and blocks of lanes are abandoned as soon as all of them exceed the radius.
   Groups beyond ``BLOCK`` rows are dealt into pairs of chunks, so every pair
   of rows still meets and no task holds a whole hot group.
4. Links: a task emits a spanning star of what it linked, not all pairs;
   components of these links equal the components of all links.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; repeated rows share one fingerprint; rows with a null id get the
component of their fingerprint (component_id is the smallest non-null id, null
if there is none); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import doc_fields, materialize
from sitelens.llm.components import connected_components

SEED = 42
#: Rows of a group that one task compares at once; larger groups are split.
BLOCK = 4096
#: Groups up to this size are compared by shifted lanes, many at a time.
SMALL = 32
#: Rows buffered in a task before they are compared (whole groups).
BUFFER = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of a text (unsigned)."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, BUFFER):
        spans = zip(starts[at:at + BUFFER].tolist(), ends[at:at + BUFFER].tolist())
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", text_key: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and, if wanted,
    text_key (hash of the text)."""
    key = [T.StructField("text_key", T.LongType())] if text_key else []
    schema = doc_fields(docs, id_col, T.StructField("fp", T.LongType()), *key)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=schema.names)

    return docs.select(id_col, text_col, *([F.xxhash64(text_col).alias("text_key")] if text_key else [])).mapInArrow(run, schema)


def blocks_for(n: int, radius: int) -> int:
    """Number of bit blocks: keys of at least log2(n) bits, radius + 2 blocks
    at least."""
    m = radius + 2
    while 64 * (m - radius) // m < n.bit_length() and m < 16:
        m += 1
    return m


def block_masks(m: int, radius: int) -> list[int]:
    """Masks (signed longs) of every choice of ``m - radius`` of m blocks."""
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def to_planes(fp: np.ndarray) -> np.ndarray:
    """(64, n) bits of n fingerprints, one row per bit."""
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def pack(planes: np.ndarray) -> np.ndarray:
    """Bit planes as machine words: (64, words of 64 lanes)."""
    n = planes.shape[1]
    full = np.zeros((64, -(-n // 64) * 64), np.uint8)
    full[:, :n] = planes
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The first n lanes of each row of words, as booleans."""
    raw = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(raw, axis=-1, bitorder="little")[..., :n].astype(bool)


def within(left: np.ndarray, right: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose planes differ in at most ``radius`` (< 8) bits.

    ``left`` and ``right`` are (64, rows, words) and may broadcast in rows or
    words.  Returns the rows that are still alive at the end and their result
    words; every row left out has no lane within the radius.
    """
    rows = np.arange(max(left.shape[1], right.shape[1]))
    shape = (len(rows), max(left.shape[2], right.shape[2]))
    ones, twos, fours, over = (np.zeros(shape, "<u8") for _ in range(4))

    def beyond():
        more, same = over.copy(), np.full(over.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
        for plane, bit in ((fours, radius & 4), (twos, radius & 2), (ones, radius & 1)):
            if bit:
                same &= plane
            else:
                more |= same & plane
                same &= ~plane
        return more

    for p in range(64):
        a = left[p] if left.shape[1] == 1 else left[p][rows]
        b = right[p] if right.shape[1] == 1 else right[p][rows]
        x = a ^ b
        carry = ones & x
        ones ^= x
        x = twos & carry
        twos ^= carry
        carry = fours & x
        fours ^= x
        over |= carry
        if p % step == step - 1:
            alive = ~(beyond() == np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
            if not alive.all():
                rows, ones, twos, fours, over = (z[alive] for z in (rows, ones, twos, fours, over))
                if not len(rows):
                    break
    return rows, ~beyond()


def small_links(fp: np.ndarray, group: np.ndarray, radius: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs inside small groups (``group`` is sorted): lane i
    holds row i, compared with the lanes shifted by 1, 2, ..."""
    left_all, right_all = [], []
    planes = to_planes(fp)
    d = 1
    while True:
        same = np.flatnonzero(group[:-d] == group[d:]) if d < len(group) else []
        if not len(same):
            break
        a, b = pack(planes[:, same]), pack(planes[:, same + d])
        pad = -a.shape[1] % width
        if pad:  # lanes beyond the end must never be within the radius
            a = np.pad(a, ((0, 0), (0, pad)))
            b = np.pad(b, ((0, 0), (0, pad)))
        rows, hits = within(a.reshape(64, -1, width), b.reshape(64, -1, width), radius)
        at = np.flatnonzero(lanes(hits, width * 64).ravel())
        lane = rows[at // (width * 64)] * (width * 64) + at % (width * 64)
        lane = lane[lane < len(same)]
        left_all.append(same[lane])
        right_all.append(same[lane] + d)
        d += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left_all), np.concatenate(right_all)) if left_all else (none, none)


def block_links(queries: np.ndarray, rows: np.ndarray, radius: int, at_once: int = 256):
    """Linked (query, row) index pairs of two sets of fingerprints, a block
    of queries at a time."""
    stored = pack(to_planes(rows))[:, None, :]
    for start in range(0, len(queries), at_once):
        part = queries[start:start + at_once]
        masks = to_planes(part).astype("<u8") * np.uint64(0xFFFFFFFFFFFFFFFF)
        alive, hits = within(stored, masks[:, :, None], radius)
        if len(alive):
            q, lane = np.nonzero(lanes(hits, len(rows)))
            yield alive[q] + start, lane


def smallest_linked(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of every index: the smallest index it is linked to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def link_groups(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint pairs) of a run of whole groups.

    ``key`` numbers the groups in order; ``side`` is 0 for rows compared among
    themselves, 1 / 2 for the two chunks of a pair.
    """
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    pairs = []
    few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes) & (side == 0)
    at = np.flatnonzero(few)
    if len(at):
        a, b = small_links(fp[at], key[at], radius)
        pairs.append((at[a], at[b]))
    for s, size in zip(starts.tolist(), sizes.tolist()):
        if size == 1 or (size <= SMALL and side[s] == 0):
            continue
        own = np.arange(s, s + size)
        if side[s] == 0:
            q = r = own
        else:
            q, r = own[side[own] == 1], own[side[own] == 2]
        if len(q) and len(r):
            pairs += [(q[i], r[j]) for i, j in block_links(fp[q], fp[r], radius)]
    pairs = [(a, b) for a, b in pairs if len(a)]
    if not pairs:
        return fp[:0], fp[:0]
    label = smallest_linked(len(fp), pairs)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` that differ
    in at most ``radius`` bits."""
    masks = block_masks(blocks_for(max(1, distinct.count()), radius), radius)
    keyed = distinct.select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")) for i, mask in enumerate(masks)
        ])).alias("k"), "fp",
    ).select("k.band", "k.bits", "fp")
    large = materialize(
        keyed.groupBy("band", "bits").agg(F.count("*").alias("rows")).filter(F.col("rows") > block), "simhash-large"
    )
    zero = F.lit(0)
    if large.isEmpty():
        parts = keyed.select("band", "bits", zero.alias("i"), zero.alias("j"), zero.alias("side"), "fp")
    else:
        # A large group becomes every pair of its chunks: (c, c) compares a
        # chunk with itself, (c, x) one chunk with another.
        chunks = F.ceil(F.col("rows") / block).cast("int")
        chunk = F.coalesce(F.pmod(F.xxhash64("fp"), chunks).cast("int"), zero)
        parts = (
            keyed.join(large, ["band", "bits"], "left")
            .select("band", "bits", "fp", chunk.alias("c"),
                    F.explode(F.sequence(zero, F.coalesce(chunks, F.lit(1)) - 1)).alias("x"))
            .select(
                "band", "bits", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"),
                F.when(F.col("c") == F.col("x"), 0).when(F.col("c") < F.col("x"), 1).otherwise(2).alias("side"), "fp",
            )
        )
    keys = ["band", "bits", "i", "j"]
    parts = parts.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def linked(table: pa.Table, last: bool):
            cols = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(len(table), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            end = len(table) if last else int(np.flatnonzero(change)[-1]) if change.any() else 0
            fp = table.column("fp").to_numpy().view(np.uint64)
            a, b = link_groups(np.cumsum(change)[:end], table.column("side").to_numpy()[:end], fp[:end], radius)
            return end, pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BUFFER:
                whole = pa.Table.from_batches(held)
                end, out = linked(whole, False)
                yield out
                held = whole.slice(end).combine_chunks().to_batches()
                rows = len(whole) - end
        if rows:
            yield linked(pa.Table.from_batches(held), True)[1]

    return parts.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
    text_key: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits),
    component_id (smallest doc_id reachable over links, itself included) and,
    if wanted, text_key (hash of the text) and root (one fingerprint that
    names the component, also where ids repeat or are null)."""
    if not 0 <= radius < 8:
        raise ValueError("radius must be between 0 and 7")
    own = materialize(fingerprints(docs, shingle, id_col, text_col, text_key), "simhash-fp")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    found = connected_components(links(nodes.select("fp"), radius, block), name="simhash")
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return own.join(component, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        *(["text_key", "root"] if text_key else []),
    )
