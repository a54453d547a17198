"""Substring dedup over a Burrows-Wheeler transform, distributed by minimizers.

A byte is removed if it is covered by a ``length``-byte string that also
starts in a document with a smaller id.  Strings never cross documents.

1. Every string of ``length`` bytes picks its smallest K-byte piece (the
   minimizer; a function of the string alone), so equal strings meet under
   the same minimizer.  Neighbouring strings that pick the same piece form one
   segment.  A task sends a row per segment: minimizer, digest of the
   segment, id and position.  Equal segments inside a task's batch are settled
   at once, so a very frequent passage is combined before the shuffle.
2. Sorted by minimizer, digest and id, the first id of equal segments is the
   smallest; later ones are covered.  A first segment stays in question only
   if another document shares the minimizer and the 17 bytes on one of its
   sides: any shared string contains one of the two.
3. The bytes of the segments in question are cut out, brought together by
   minimizer, and searched in batches: sorted suffixes give the transform, and
   breadth-first backward extension of intervals derives the common-prefix
   values 0, 1, 2, ... in increasing order, stopping at ``length``.
   Neighbouring suffixes without a value by then share a string; every
   occurrence in a document larger than the smallest one is covered.
4. Covered runs are joined back to the texts, merged and cut.

Hot minimizers (more than ``hot_rows`` segments in question) are cut into
single strings keyed by their own hash, so no group of differing segments has
to fit one task; equal strings stream past the first of them.

Defined results: a null text is empty; rows with a null id neither lose bytes
nor remove any; rows with the same id are one document (never compared with
each other); repeated rows give repeated results; texts shorter than
``length`` bytes stay whole; an empty table gives an empty result; other
columns are ignored.  Ids must be integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import doc_fields, materialize

K = 16
#: Bytes of text that one vectorised step works on; longer texts are cut into
#: overlapping slices.
SLICE = 1 << 20
#: Bytes of segments searched in one transform.
BATCH = 1 << 18
#: Rows buffered by a task while it looks for the end of a minimizer's group; a
#: group that fills two buffers is settled in parts.
BUFFER = 1 << 16
_POS = 24
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def _eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one number (zeros past the end)."""
    x = np.zeros(len(b) + 8, np.uint64)
    x[:len(b)] = b
    for shift in (1, 2, 4):
        x[:-shift] |= x[shift:] << np.uint64(8 * shift)
    return x[:len(b)]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (w - width)], x[w - width:]) if w > width else x


def segments(b: np.ndarray, doc: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of concatenated texts; ``doc`` numbers the text of each byte.

    first (position), count (strings), mini, digest, left and right (13-bit
    hashes of the 17 bytes beside the minimizer, 0 where the segment does not
    hold them all).
    """
    n = len(b)
    if n < length:
        return {}
    x = _eights(b)
    piece = _mix(x[:n - K + 1] * _M1 ^ (x[8:n - K + 9] + _M3) * _M2) >> np.uint64(_POS)
    ranked = (piece << np.uint64(_POS)) | np.arange(len(piece), dtype=np.uint64)
    low = _window_min(ranked, length - K + 1)
    whole = doc[:n - length + 1] == doc[length - 1:]
    at = np.flatnonzero(whole)
    if not len(at):
        return {}
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    first = at[starts]
    count = np.diff(np.append(starts, len(at)))
    mini = (low[starts] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    end = first + count + length - 1

    # First and last ``length`` bytes cover a segment, as it has at most
    # 2 * length - K of them.
    digest = count.astype(np.uint64) * _M1
    offsets = [*range(0, length - 8, 8), length - 8]
    for o in offsets:
        digest = _mix(digest * _M1 + x[first + o])
        digest = _mix(digest * _M2 + x[end - length + o])
    digest >>= np.uint64(8)

    side = (length - K) // 2
    def beside(p, ok):
        p = np.where(ok, p, 0)
        h = np.zeros(len(p), np.uint64)
        for o in [*range(0, side - 8, 8), side - 8]:
            h = _mix(h * _M1 + x[p + o])
        return np.where(ok, (h >> np.uint64(20)) % np.uint64(8191) + np.uint64(1), 0).astype(np.int64)

    return {
        "first": first, "count": count, "mini": piece[mini].astype(np.int64), "digest": digest.astype(np.int64),
        "left": beside(mini - side, first <= mini - side), "right": beside(mini + K, mini + K + side <= end),
    }


_ROWS = "mini long, digest long, doc_id long, text_key long, place long"
_FOUND = "open boolean, mini long, doc_id long, text_key long, first int, count int"
#: Digest of a row that is already known to be covered.
_SETTLED = -1


def _place(first, count, left=0, right=0):
    return (((left << 13) | right) << 38) | (first.astype(np.int64) << 6) | count


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row per segment of (doc_id, text_key, text)."""

    def emit(ids, keys, texts, offsets):
        b = np.frombuffer(b"".join(texts), np.uint8)
        sizes = [len(t) for t in texts]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        got = segments(b, doc, length)
        if not got:
            return None
        at = doc[got["first"]]
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        first = got["first"] - base[at] + np.array(offsets)[at]
        doc_id, key = np.array(ids, np.int64)[at], np.array(keys, np.int64)[at]
        order = np.lexsort((doc_id, got["digest"], got["mini"]))
        mini, digest, doc_id, key, first, count = (
            z[order] for z in (got["mini"], got["digest"], doc_id, key, first, got["count"]))
        new = np.ones(len(order), bool)
        new[1:] = (mini[1:] != mini[:-1]) | (digest[1:] != digest[:-1])
        smallest = doc_id[np.flatnonzero(new)][np.cumsum(new) - 1]
        settled = doc_id > smallest
        place = np.where(settled, _place(first, count), _place(first, count, got["left"][order], got["right"][order]))
        # Settled rows only pass through the next step: spread them evenly.
        mini = np.where(settled, (doc_id * 1_000_003 + first) & ((1 << 40) - 1), mini)
        return pa.RecordBatch.from_arrays(
            [pa.array(mini), pa.array(np.where(settled, _SETTLED, digest)), pa.array(doc_id), pa.array(key), pa.array(place)],
            names=["mini", "digest", "doc_id", "text_key", "place"],
        )

    def run(batches):
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode("utf-8")
                if len(data) < length:
                    continue
                for at in range(0, max(1, len(data) - length + 1), SLICE):
                    part = data[at:at + SLICE + length - 1]
                    for column, value in zip(held, (doc_id, key, part, at)):
                        column.append(value)
                    size += len(part)
                    if size >= SLICE:
                        out = emit(*held)
                        if out is not None:
                            yield out
                        held, size = ([], [], [], []), 0
        if size:
            out = emit(*held)
            if out is not None:
                yield out

    return docs.mapInArrow(run, _ROWS)


def _shared(group: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose (group, side) also has a row of another document."""
    order = np.lexsort((side, group))
    g, s, d = group[order], side[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    mixed = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
    out = np.zeros(len(order), bool)
    out[order] = mixed[np.cumsum(new) - 1] & (s != 0)
    return out


def _decide(table: pa.Table, carry, forced: bool):
    mini, digest, doc, key, place = (table.column(i).to_numpy() for i in range(5))
    new = np.ones(len(mini), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (digest[1:] != digest[:-1])
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    if carry is not None and (mini[0], digest[0]) == carry[:2]:
        same = np.cumsum(new) == 1
        smallest = np.where(same, carry[2], smallest)
    covered = (digest == _SETTLED) | (doc > smallest)
    left = np.flatnonzero(~covered)
    question = np.zeros(len(mini), bool)
    if len(left):
        if forced:  # part of a group beyond the buffer: all stay in question
            question[left] = True
        else:
            sides = place[left] >> 38
            question[left] = _shared(mini[left], (sides >> 13) & 8191, doc[left]) | _shared(mini[left], sides & 8191, doc[left])
    take = np.flatnonzero(covered | question)
    return (mini[-1], digest[-1], smallest[-1]), pa.RecordBatch.from_arrays(
        [pa.array(question[take]), pa.array(mini[take]), pa.array(doc[take]), pa.array(key[take]),
         pa.array(((place[take] >> 6) & 0xFFFFFFFF).astype(np.int32)), pa.array((place[take] & 63).astype(np.int32))],
        names=["open", "mini", "doc_id", "text_key", "first", "count"],
    )


def settled_batches(batches):
    """Decides on rows in order of mini, digest and doc_id; holds two buffers at most."""
    held: list[pa.RecordBatch] = []
    size, due, carry, forced = 0, BUFFER, None, False
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < due:
            continue
        table = pa.Table.from_batches(held)
        mini = table.column(0).to_numpy()
        ends = np.flatnonzero(mini[1:] != mini[:-1])
        if len(ends):
            if forced:  # the rest of the oversized group comes first
                cut = int(ends[0]) + 1
                carry, out = _decide(table.slice(0, cut), carry, True)
                yield out
                table, forced = table.slice(cut), False
                ends = ends[1:] - cut
            if len(ends):
                cut = int(ends[-1]) + 1
                carry, out = _decide(table.slice(0, cut), None, False)
                yield out
                table = table.slice(cut)
        elif size >= 2 * BUFFER:
            carry, out = _decide(table, carry, True)
            yield out
            table, forced = table.slice(len(table)), True
        held = table.combine_chunks().to_batches()
        size = len(table)
        # A group that fills the buffer is not searched for its end at every batch.
        due = BUFFER if size < BUFFER else 2 * BUFFER
    if size:
        table = pa.Table.from_batches(held)
        if forced:
            mini = table.column(0).to_numpy()
            ends = np.flatnonzero(mini[1:] != mini[:-1])
            cut = int(ends[0]) + 1 if len(ends) else len(table)
            yield _decide(table.slice(0, cut), carry, True)[1]
            table = table.slice(cut)
        if len(table):
            yield _decide(table, None, False)[1]


def settle(rows: DataFrame) -> DataFrame:
    """Covered segments (open = false) and segments in question (open =
    true): mini, doc_id, text_key, first, count."""
    parts = rows.repartition("mini").sortWithinPartitions("mini", "digest", "doc_id")
    return parts.mapInArrow(settled_batches, _FOUND)


def shared_strings(texts: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """Per text, the positions of its ``length``-byte strings that also start
    in a text of a smaller document of the list."""
    sizes = np.array([len(t) for t in texts])
    n = int(sizes.sum()) + len(texts)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    symbol = np.zeros(n, np.int64)  # 0 ends a text
    joined = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.ones(n, bool)
    inside[starts + sizes] = False
    symbol[inside] = joined.astype(np.int64) + 1

    # Suffixes in order of at least their first ``length`` symbols: seven
    # 9-bit symbols make one number, then prefixes are doubled.
    rank = symbol.copy()
    for ahead in range(1, 7):
        rank <<= 9
        rank[:-ahead] |= symbol[ahead:]
    width = 7
    _, rank = np.unique(rank, return_inverse=True)
    while width < length:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:]
        _, rank = np.unique(rank * (int(rank.max()) + 2) + after + 1, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # The transform, as the row each suffix moves to when it is extended
    # backward by the symbol before it (-1 at the start of a text).  Rows of
    # one interval that move to consecutive rows under one symbol are the
    # backward extension of the interval by that symbol.
    back = place[order - 1]
    back[symbol[order - 1] == 0] = -1
    head = symbol[order].astype(np.int16)

    value = np.full(n + 1, -1, np.int16)
    value[0] = value[n] = 0
    # The single symbols first: prefixes of length 1.
    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    value[first] = 0
    owner = np.zeros(n, np.int32)  # interval of each row that is still open
    owner[first] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    rows = np.arange(n)
    for prefix in range(1, length):
        moved = back[rows]
        come = moved >= 0
        moved, source = moved[come], owner[rows[come]]
        if not len(moved):
            break
        if len(moved) > n >> 4:  # put in row order by position, else by sorting
            at = np.full(n, -1, np.int32)
            at[moved] = source
            rows = np.flatnonzero(at >= 0)
            source = at[rows]
        else:
            by = np.argsort(moved, kind="stable")
            rows, source = moved[by], source[by]
        new = np.ones(len(rows), bool)
        new[1:] = (source[1:] != source[:-1]) | (head[rows[1:]] != head[rows[:-1]]) | (rows[1:] != rows[:-1] + 1)
        first = np.flatnonzero(new)
        left, right = rows[first], rows[np.append(first[1:], len(rows)) - 1] + 1
        fresh = (value[right] < 0) | (value[left] < 0)
        value[right[value[right] < 0]] = prefix
        value[left[value[left] < 0]] = prefix
        run = np.cumsum(new) - 1
        kept = fresh[run]
        rows = rows[kept]
        owner[rows] = run[kept]

    group = np.cumsum(value[:n] >= 0) - 1
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(n) - starts[of]
    valid = offset[order] + length <= sizes[of[order]]
    owner_doc = docs[of[order]]
    smallest = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group[valid], owner_doc[valid])
    hit = order[valid & (owner_doc > smallest[group])]
    hit.sort()
    cuts = np.searchsorted(of[hit], np.arange(len(texts) + 1))
    return [offset[hit[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


def _runs(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of runs of consecutive positions."""
    new = np.ones(len(positions), bool)
    new[1:] = positions[1:] != positions[:-1] + 1
    at = np.flatnonzero(new)
    return positions[at], np.diff(np.append(at, len(positions)))


def search(open_rows: DataFrame, docs: DataFrame, length: int, hot_rows: int, broadcast_rows: int, repeated: bool = True) -> DataFrame:
    """Covered runs (doc_id, text_key, first, count) of the segments in
    question; ``repeated``: rows of ``docs`` may repeat id and text."""
    hot = materialize(open_rows.groupBy("mini").count().filter(F.col("count") > hot_rows).select("mini", F.lit(True).alias("hot")), "bwt-hot")
    marked = open_rows.join(F.broadcast(hot) if hot.count() <= broadcast_rows else hot, "mini", "left")
    per_doc = materialize(
        marked.groupBy("doc_id", "text_key").agg(
            F.collect_list(F.struct("mini", "first", "count", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("cuts")
        ), "bwt-cuts",
    )
    ids = per_doc.select("doc_id").distinct()
    if ids.count() <= broadcast_rows:  # else the join alone finds the texts
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    # Without repeated ids no text is shuffled but for the join.
    docs = docs.distinct() if repeated else docs
    texts = docs.join(per_doc, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "cuts")

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8")
                for c in cuts:
                    first, count = c["first"], c["count"]
                    if c["hot"]:
                        for p in range(first, first + count):
                            piece = data[p:p + length]
                            rows.append((xxhash.xxh64_intdigest(piece) >> 1, doc_id, key, p, piece))
                    else:
                        rows.append((c["mini"], doc_id, key, first, data[first:first + count + length - 1]))
            for at in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, kind) for col, kind in zip(
                        zip(*rows[at:at + (1 << 16)]), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                    names=["key", "doc_id", "text_key", "first", "piece"],
                )

    pieces = texts.mapInArrow(cut, "key long, doc_id long, text_key long, first int, piece binary")
    pieces = pieces.repartition("key").sortWithinPartitions("key", "piece", "doc_id")
    schema = "doc_id long, text_key long, first int, count int"

    def run(batches):
        held: list[tuple] = []  # (doc_id, text_key, first, piece)
        out: list[tuple] = []
        size, last_key, last_piece, last_doc = 0, None, None, None

        def flush():
            nonlocal held, size
            if len(held) > 1:
                hits = shared_strings([h[3] for h in held], np.array([h[0] for h in held], np.int64), length)
                for (doc_id, key, first, _), positions in zip(held, hits):
                    if len(positions):
                        for a, c in zip(*(z.tolist() for z in _runs(positions))):
                            out.append((doc_id, key, first + a, c))
            held, size = [], 0

        def packed():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(col, kind) for col, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                names=["doc_id", "text_key", "first", "count"])
            out.clear()
            return batch

        for batch in batches:
            for key, doc_id, text_key, first, piece in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key == last_key and piece == last_piece and doc_id > last_doc:
                    out.append((doc_id, text_key, first, len(piece) - length + 1))
                    continue
                if key != last_key and size >= BATCH:
                    flush()
                if (key, piece) != (last_key, last_piece):
                    last_key, last_piece, last_doc = key, piece, doc_id
                held.append((doc_id, text_key, first, piece))
                size += len(piece) + 1
            if len(out) >= 1 << 16:
                yield packed()
        flush()
        if out:
            yield packed()

    return pieces.mapInArrow(run, schema)


def covered_runs(docs: DataFrame, length: int = 50, hot_rows: int = 20_000, broadcast_rows: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, first, count): runs of covered strings."""
    if not 2 * K <= length <= 64:
        raise ValueError("length must be between 32 and 64 bytes")
    own = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= length)).select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), F.col(text_col).alias("text")
    )
    repeated = repeated_ids(docs, id_col)
    if repeated:
        own = own.withColumn("text_key", F.xxhash64("text"))
    found = materialize(settle(segment_rows(own, length)), "bwt-segments")
    more = search(found.filter("open").drop("open"), own, length, hot_rows, broadcast_rows, repeated)
    return found.filter("NOT open").select("doc_id", "text_key", "first", "count").unionByName(more)


def repeated_ids(docs: DataFrame, id_col: str) -> bool:
    """Do any two rows share an id?  (Then positions are told apart by text.)"""
    return not docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").isEmpty()


def dedup_substrings(
    docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 20_000,
    broadcast_rows: int = 2_000_000, keep_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and, if wanted, removed (byte spans) and kept (the remaining bytes)."""
    runs = covered_runs(docs, length, hot_rows, broadcast_rows, id_col, text_col)
    per_doc = materialize(
        runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "count")).alias("runs")), "bwt-runs"
    )
    key = F.xxhash64(text_col) if repeated_ids(docs, id_col) else F.lit(0).cast("long")
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    per_doc = per_doc.withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    on = (own["doc_id"] == per_doc["d"]) & (own["text_key"] == per_doc["t"])
    extra = [
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType()),
    ] if keep_text else []
    schema = doc_fields(
        docs, id_col, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept_sha256", T.StringType()), *extra,
    )

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8")
                spans: list[list[int]] = []
                for first, count in sorted((r["first"], r["count"]) for r in found or ()):
                    end = first + count + length - 1
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([first, end])
                kept = b"".join(data[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(data)]))
                row = [len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()]
                rows.append(row + ([[{"start": a, "end": b} for a, b in spans], kept] if keep_text else []))
            columns = list(zip(*rows)) or [()] * (len(schema.names) - 1)
            kinds = [pa.int64()] * 3 + [pa.string()]
            if keep_text:
                kinds += [pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return own.join(per_doc, on, "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
