"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds its distinct word shingles as 64-bit hashes; the k
smallest are its sketch.  Documents with equal sets are one class, so copies
are compared once.  Classes are linked if the Jaccard similarity of their full
sets reaches ``percent``; components of links are the result.

* **Inverted lists** of retained values.  Two sets that are similar share at
  least ``least_shared`` values of their sketches, so they share one among the
  rarest ``size - least_shared + 1`` of each; only these are listed, ordered by
  the number of sketches that hold them.
  Lists with the same members count once.
* **Leaders.**  In each of two rounds every list names one member; the others
  are paired with it (as many pairs as members), after which it leaves the
  list.  The components of the confirmed pairs give the roots; lists with a
  single root or member are done, so a group of thousands of near copies falls
  together without its pairs.
* **Blocks.**  All pairs of different roots in the lists that are left
  are compared inside tasks, in blocks of bounded size, by the overlap of their
  sketches (31 bits of each value; one match less than needed is let through,
  as two values of a set may agree in them).  A block sends its pairs if they
  are fewer than the members that have one.  Else it sends these members:
  they meet once more with their full sets (31 bits of each value; values of a
  set that agree in them count as shared), and only pairs that these let
  through leave the block.  So the rows between tasks grow with the members
  of the lists, not with their pairs.
  Two members meet in the list of their smallest common value only.
* **Union sketch.**  The k smallest values of both sketches together are the
  sketch of the union; the share of them in both estimates the similarity and
  drops pairs that cannot reach ``percent``.
* **Exact check.**  The full sets of the remaining pairs are read from the
  texts again (picked by a fixed-size filter of their rows) and compared.

``least_shared``: if both sets fit into their sketches the bound is certain;
beyond, it is the count that a similar pair misses with a probability below
1e-12.  The union sketch is k draws without replacement from the union, so up
to ``16 * k`` values the hypergeometric law gives the count, for larger sets a
Chernoff bound.  Hot values, leaders and classes are joined with salts.

Defined results: a null or empty text or one without words has no set, is
linked with nothing and keeps its own id; a text with fewer words than a
shingle is one shingle; rows that repeat both id and text get the same result;
null ids are never the smallest (a component of null ids has a null id, and
its rows count as kept); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.keyfilter import filter_bits, hash_filter, may_contain_hash
from sitelens.functions.skew import skew_join
from sitelens.llm.common import materialize
from sitelens.llm.components import connected_components
from sitelens.session import discard

#: A-Z to lower case, in UTF-8 bytes.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Odd factors: of a shingle's polynomial and of the two steps that mix its bits.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Members of a list, and values of their full sets, of one chunk; a task
#: compares two chunks at once.
BLOCK, BLOCK_VALUES = 4096, 1 << 22
#: Values held by more members of a block than this are counted by products of
#: matrices of so many columns, others pair by pair.
FEW, COLUMNS = 32, 2048
#: Rounds of leaders before the blocks.
LEADER_TURNS = 2
#: Natural log of the probability that a bound misses a similar pair.
LOG_MISS = math.log(1e-12)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles, ascending: every word is hashed once,
    a shingle is a polynomial of its words' hashes and their number, mixed."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * _FACTOR + each[i:i + len(h)]
    for factor in _MIX:
        h = (h ^ (h >> np.uint64(33))) * factor
    return np.unique((h ^ (h >> np.uint64(33))).view(np.int64))


def set_key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


@lru_cache
def chernoff_count(k: int, percent: int) -> int:
    """The largest count c of k draws (each a hit with ``percent``) such that
    fewer than c hits have a probability below 1e-12; 1 at least."""
    t = percent / 100

    def log_tail(c):
        p = c / k
        return -k * ((p * math.log(p / t) if p else 0) + (1 - p) * math.log((1 - p) / (1 - t)))

    return max(1, max((c for c in range(k) if c / k < t and log_tail(c) <= LOG_MISS), default=1))


@lru_cache
def shared_table(k: int, percent: int) -> list[int]:
    """``least_shared`` of sets of 0 to ``16 * k`` values."""
    top = 16 * k
    most = top * 100 // percent
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))

    def log_choose(n, x):
        return logs[n] - logs[x] - logs[n - x]

    least = np.zeros(most + 1, np.int64)  # by the size of the union
    for size in range(1, most + 1):
        both, draws = -(-percent * size // 100), min(k, size)
        hits = np.arange(max(0, draws - (size - both)), min(draws, both) + 1)
        log_p = log_choose(both, hits) + log_choose(size - both, draws - hits) - log_choose(size, draws)
        fewer = np.concatenate(([-np.inf], np.logaddexp.accumulate(log_p[:-1])))
        least[size] = hits[np.flatnonzero(fewer <= LOG_MISS)[-1]]
    return [0] + [min(-(-percent * n // 100), int(least[n:n * 100 // percent + 1].min())) for n in range(1, top + 1)]


def least_shared(n, k: int, percent: int):
    """Values that the sketches of a set of ``n`` (number or column) and of
    any similar set share at least."""
    table, beyond = shared_table(k, percent), chernoff_count(k, percent)
    if isinstance(n, Column):
        return F.when(n < len(table), F.get(F.lit(table), n.cast("int"))).otherwise(F.lit(beyond)).cast("int")
    return np.where(n < len(table), np.array(table)[np.minimum(n, len(table) - 1)], beyond).astype(np.int64)


def union_estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int, k: int, percent: int) -> bool:
    """False if the union sketch rules the pair out.  Sketches in their order,
    whole values or some bits of each: values that agree in these count as
    shared, and none as greater than it is."""
    same = a[:, None] == b
    hit = same.any(axis=1)
    if na <= k and nb <= k:
        shared = int(hit.sum())
        return 100 * shared >= percent * (na + nb - shared)
    # Values of the union below a shared one: those before it in both, shared ones once.
    below = np.arange(len(a)) + same.argmax(axis=1) - (np.cumsum(hit) - hit)
    shared = int((hit & (below < k)).sum())
    table = shared_table(k, percent)
    return shared >= max(table[n] if n < len(table) else chernoff_count(k, percent) for n in (na, nb))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, row_key, key, n, sketch) of every row; key, the digest of the
    set, is null for an empty set."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row_key", T.LongType()),
        T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        for batch in batches:
            keys, sizes, parts = [], [], []
            for text in batch.column(2).to_pylist():
                values = shingle_set(text, shingle)
                keys.append(set_key(values) if len(values) else None)
                sizes.append(len(values))
                parts.append(values[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), _lists(parts)], names=schema.names
            )

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, full) of the wanted (sid, key, row_key); only the texts of these
    rows leave the scan."""
    bits = filter_bits(wanted.count())
    words = hash_filter(wanted, "row_key", bits)
    own = docs.select("text", F.xxhash64("doc_id", "text").alias("row_key")).filter(may_contain_hash(words, F.col("row_key"), bits))

    def run(batches):
        for batch in batches:
            parts = [shingle_set(text, shingle) for text in batch.column(2).to_pylist()]
            own = pa.array([set_key(p) == key for p, key in zip(parts, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts)], names=["sid", "full"]).filter(own)

    # Rows that repeat id and text, once: by the key of the join, so that no set is shuffled for it.
    texts = own.join(wanted, "row_key").dropDuplicates(["row_key", "sid", "key", "text"]).select("sid", "key", "text")
    return texts.mapInArrow(run, "sid long, full array<bigint>")


def postings_of(sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, sid, n): inverted lists of the rarest retained values."""
    entries = sets.select("sid", F.explode("sketch").alias("value"))
    counts = materialize(entries.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1"), "sketch-counts")
    often = skew_join(entries, counts, "value", counts=counts)
    own = often.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("often")).join(sets.select("sid", "n"), "sid")
    size = F.least(F.col("n"), F.lit(k)).cast("int")
    # Values held by one sketch are the rarest: they take their places of the prefix first.
    places = size - least_shared(F.col("n"), k, percent) + 1 - (size - F.size("often"))
    listed = own.select("sid", "n", F.explode(F.slice("often", F.lit(1), F.greatest(places, F.lit(0)))).alias("v"))
    return listed.select(F.col("v.value").alias("value"), "sid", "n")


def _open_lists(lists: DataFrame, turn: int) -> DataFrame:
    """The lists with members of two roots at least, once per set of
    members, with the member that each names this turn."""
    h, g = F.xxhash64("sid"), F.xxhash64(F.lit(1), "sid")
    order = F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "root", "n")
    states = lists.groupBy("value").agg(
        F.count("*").alias("c"), (F.min("root") != F.max("root")).alias("open"), F.bit_xor(h).alias("h"), F.bit_xor(g).alias("g"),
        F.min(order).alias("lead"),
    )
    first = states.filter("c > 1 AND open").groupBy("c", "h", "g").agg(F.min(F.struct("value", "lead")).alias("f"))
    lead = F.struct("f.lead.sid", "f.lead.root", "f.lead.n").alias("lead")
    first = materialize(first.select("f.value", lead, "c"), "list-leaders")
    return materialize(skew_join(lists, first.drop("c"), "value", counts=first.select("value", "c")), "open-lists")


def _leader_pairs(led: DataFrame, percent: int) -> DataFrame:
    sized = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    return led.filter((F.col("root") != F.col("lead.root")) & sized).select(F.col("sid").alias("a"), F.col("lead.sid").alias("b")).distinct()


def _block_pairs(lists: DataFrame, sets: DataFrame, k: int, percent: int, read=None) -> DataFrame:
    """(a, b): pairs of different roots in the lists whose sketches pass and,
    in blocks of more such pairs than members, whose full sets pass; ``read``
    gives the (sid, full) of rows of ``sets`` (without it, sketches decide)."""
    size = materialize(lists.groupBy("value").agg(F.count("*").alias("c"), F.sum("n").alias("values")), "list-sizes")
    chunks = size.select("value", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("values") / BLOCK_VALUES)).cast("int").alias("chunks"))
    members = skew_join(lists, chunks, "value", counts=size.select("value", "c"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = members.withColumn("o", other).select(
        "value", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "sid", "n", "root"
    )
    # Two members that share several lists are a pair in the list of their smallest value alone.
    listed = lists.groupBy("sid").agg(F.collect_list("value").alias("listed"))
    earlier = F.filter("listed", lambda x: x < F.col("value"))
    dealt = dealt.join(listed, "sid").withColumn("earlier", earlier).drop("listed")
    found = _compare_blocks(dealt, sets.select("sid", "sketch"), lambda *held: _sketch_pairs(*held, k, percent), members=read is not None)
    if read is None:
        return found.select("a", "b").distinct()
    found = materialize(found, "block-pairs")
    dense = found.filter("b IS NULL").select("value", "i", "j", "chunk", F.col("a").alias("sid"), "n", "root", "earlier")
    pairs = found.filter("b IS NOT NULL").select("a", "b")
    if dense.isEmpty():
        return pairs.distinct()
    full = read(sets.join(dense.select("sid").distinct(), "sid", "left_semi"))
    exact = _compare_blocks(dense, full, lambda *held: _full_pairs(*held, percent), members=False)
    return pairs.unionByName(exact.select("a", "b")).distinct()


_BLOCK_ROWS = "a long, b long, value long, i int, j int, chunk int, n long, root long, earlier array<bigint>"


def _compare_blocks(dealt: DataFrame, arrays: DataFrame, compare, members: bool) -> DataFrame:
    """Pairs (a, b) that ``compare`` finds in every block (value, i, j); with
    ``members``, a block of no fewer pairs than members that have one gives
    these members instead (a, b null, with the other columns).  ``earlier`` of
    ``dealt``: smaller values of a member's lists, where its other pairs meet."""
    name = arrays.columns[1]
    small = F.transform(name, lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    rows = dealt.join(arrays.select("sid", small.alias("small")), "sid").select("value", "i", "j", "chunk", "sid", "n", "root", "small", "earlier")

    def emit(held, group):
        if len({m[0] for m in held}) < 1 + (group[1] != group[2]) or len(held) < 2:
            return
        chunk, sid, n, root = (np.array(c, np.int64) for c in list(zip(*held))[:4])
        x, y = compare([m[4] for m in held], [m[5] for m in held], n, root, chunk if group[1] != group[2] else np.arange(len(held)))
        if not len(x):
            return
        own = np.unique(np.concatenate((x, y)))
        if not members or len(x) < len(own):
            a, b = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())
            rest = [pa.nulls(len(x), kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *rest], names=_names(_BLOCK_ROWS))
            return
        same = [pa.array(np.full(len(own), v), kind) for v, kind in zip(group, (pa.int64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid[own]), pa.nulls(len(own), pa.int64()), *same, pa.array(chunk[own], pa.int32()), pa.array(n[own]), pa.array(root[own]),
             _lists([held[m][5] for m in own])],
            names=_names(_BLOCK_ROWS))

    def run(batches):
        held, group = [], None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(7)] + [_arrays(batch.column(c)) for c in (7, 8)]
            for value, i, j, *member in zip(*cols):
                if (value, i, j) != group:
                    if held:
                        yield from emit(held, group)
                    held, group = [], (value, i, j)
                held.append(member)
        if held:
            yield from emit(held, group)

    key = ["value", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, _BLOCK_ROWS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _shared(parts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Values that each of the sets ``rows`` shares with each set."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, place, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    owner, starts = owner[order], np.cumsum(often) - often
    at = np.full(len(parts), -1)
    at[rows] = np.arange(len(rows))
    shared = np.zeros((len(rows), len(parts)), np.float32)
    for c in np.unique(often[(often > 1) & (often <= FEW)]):
        first = starts[often == c]
        step = max(1, (1 << 21) // (c * c))
        for k in range(0, len(first), step):
            sets = owner[first[k:k + step, None] + np.arange(c)]
            x, y = np.repeat(at[sets], c, axis=1).ravel(), np.tile(sets, (1, c)).ravel()
            np.add.at(shared.reshape(-1), x[x >= 0] * len(parts) + y[x >= 0], np.float32(1))
    many = np.flatnonzero(often > FEW)
    for k in range(0, len(many), COLUMNS):
        grid = np.zeros((len(parts), min(COLUMNS, len(many) - k)), np.float32)
        for column, value in enumerate(many[k:k + COLUMNS]):
            grid[owner[starts[value]:starts[value] + often[value]], column] = 1
        shared += grid[rows] @ grid.T
    return shared


def _pairs_of(parts, earlier, n, root, side, percent, passes):
    """(x, y) of the pairs of different roots and sides that share no earlier
    list, fit in size and pass; each has a member outside the most frequent
    root."""
    roots, place, times = np.unique(root, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(place != np.argmax(times))
    if not len(rows):
        return rows, rows
    met = _shared(earlier, rows) > 0
    shared = _shared(parts, rows)
    outside = place != np.argmax(times)
    found = []
    for k in range(0, len(rows), 256):
        x = rows[k:k + 256, None]
        ok = passes(shared[k:k + 256], x) & ~met[k:k + 256] & (root[x] != root) & (side[x] != side) & (~outside | (np.arange(len(n)) > x))
        ok &= 100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n)
        a, b = np.nonzero(ok)
        found.append((rows[k + a], b))
    return tuple(np.concatenate(c) for c in zip(*found))


def _sketch_pairs(parts, earlier, n, root, side, k, percent):
    least = least_shared(n, k, percent) - 1
    return _pairs_of([np.unique(p) for p in parts], earlier, n, root, side, percent, lambda shared, x: shared >= np.maximum(least[x], least))


def _full_pairs(parts, earlier, n, root, side, percent):
    parts = [np.unique(p) for p in parts]
    lost = n - np.array([len(p) for p in parts])

    def passes(shared, x):
        most = shared + np.minimum(lost[x], lost)
        return 100 * most >= percent * (n[x] + n - most)

    return _pairs_of(parts, earlier, n, root, side, percent, passes)


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar; b may be a hot
    leader, a has few pairs."""

    def with_sides(table: DataFrame, side: DataFrame, *names: str) -> DataFrame:
        left = table.join(side.select(F.col("sid").alias("a"), *[F.col(c).alias(c + "_a") for c in names]), "a")
        return skew_join(left, side.select(F.col("sid").alias("b"), *[F.col(c).alias(c + "_b") for c in names]), "b", counts=counts)

    def estimate(batches):
        for batch in batches:
            a, b = _arrays(batch.column(2)), _arrays(batch.column(4))
            keep = [union_estimate(*row, k, percent) for row in zip(a, b, batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for batch in batches:
            keep = []
            for a, b in zip(_arrays(batch.column(2)), _arrays(batch.column(3))):
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    counts = materialize(pairs.groupBy("b").agg(F.count("*").alias("c")), "pair-counts")
    bits = F.transform("sketch", lambda x: x.bitwiseAND(F.lit(2**15 - 1)).cast("smallint"))
    sides = with_sides(pairs, sets.select("sid", "n", bits.alias("sketch")), "sketch", "n").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
    likely = materialize(sides.mapInArrow(estimate, "a long, b long"), "likely-pairs")
    counts = materialize(likely.groupBy("b").agg(F.count("*").alias("c")), "pair-counts")
    ids = likely.select(F.col("a").alias("sid")).union(likely.select("b")).distinct()
    wanted = materialize(sets.join(ids, "sid", "left_semi").select("sid", "key", "row_key"), "wanted-sets")
    full = materialize(full_sets(docs, wanted, shingle), "full-sets")
    links = materialize(with_sides(likely, full, "full").select("a", "b", "full_a", "full_b").mapInArrow(exact, "a long, b long"), "set-links")
    discard(full)
    return links


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(sketches(own, shingle, k), "bottom-k")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    sets = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(place).alias("p"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    # A number per class, fixed by writing it once.
    sets = materialize(sets.select(
        F.monotonically_increasing_id().alias("sid"), "key", F.col("p.doc_id").alias("doc_id"), F.col("p.row_key").alias("row_key"),
        "n", "sketch", "copies"), "set-classes")
    wide, rows = rows, materialize(rows.select("doc_id", "key", "n"), "set-rows")
    discard(wide)
    lists = materialize(postings_of(sets, k, percent).withColumn("root", F.col("sid")), "inverted-lists")
    links, read = None, []

    def block_sets(wanted):
        read.append(materialize(full_sets(own, materialize(wanted.select("sid", "key", "row_key"), "wanted-sets"), shingle), "full-sets"))
        return read[-1]

    for turn in range(LEADER_TURNS + 1):
        lists = _open_lists(lists, turn)
        if lists.isEmpty():
            break
        if turn < LEADER_TURNS:
            pairs, lists = _leader_pairs(lists, percent), lists.filter("sid <> lead.sid")
        else:
            pairs = _block_pairs(lists, sets, k, percent, block_sets)
        lists, pairs = lists.drop("lead"), materialize(pairs, "pairs")
        while read:
            discard(read.pop())
        new = confirmed(pairs, own, sets, shingle, k, percent)
        links = new if links is None else links.unionByName(new)
        if turn < LEADER_TURNS:
            roots = connected_components(links, name="set-roots").withColumnRenamed("node", "sid")
            lists = materialize(lists.drop("root").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "inverted-lists")
    component = sets.select("sid", "key", F.col("doc_id").alias("component_id"), "copies")
    if links is not None:
        labels = connected_components(links, name="set-components").withColumnRenamed("node", "sid")
        both = materialize(component.join(labels, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "set-roots")
        least = both.groupBy("root").agg(F.min("component_id").alias("component_id"))
        component = materialize(skew_join(both.select("root", "key", "copies"), least, "root").select("key", "component_id", "copies"), "components")
    found = skew_join(rows.select("key", "doc_id", "n"), component.select("key", "component_id"), "key", "left", component.select("key", "copies"))
    component_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept")
    )
