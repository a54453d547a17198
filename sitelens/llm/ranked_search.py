"""Ranked lexical search: term at a time with a limited set of accumulators.

A set of queries (items) is ranked against all documents.  Terms are maximal
runs of letters and digits (ASCII letters lower-cased, every non-ASCII
character counts as a letter).  The score of a document sums, over the terms
of the item with repeats, ``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and the length norm
``m = 100 - 75 + ((75 * n * N) div L)``.

The index is partitioned by documents.  A first pass over the texts counts N,
L and the df of the query terms (one row per term and task, summed by Spark).
The second pass cuts every partition into shards of bounded size, builds the
postings of the query terms of a shard and ranks each item on it, term at a
time:

* terms are taken rarest first (by df in the whole corpus);
* while accumulators are created, every document of a term's postings gets
  one; creation stops as soon as the terms that remain cannot lift a new
  document to the k-th best partial score (the bound of a term is its weight
  times its largest impact on the shard, so it is exact);
* from then on the remaining terms only update the accumulators that exist,
  with their full contributions, so the scores of survivors are exact.

A shard returns its k best documents per item and Spark keeps the k best of
all shards (a window whose group limit runs before the shuffle).  The query
set is taken in blocks of bounded size, each ranked against all rows.

Defined results: a null or empty text has no terms; a document without a term
is not counted in N; every row of the document table is a document of its own
(repeated rows are ranked one after another); equal scores by ascending id,
null ids last; items that repeat both id and text are one item; an item id
with two texts is ranked for each of them; items without a term, without a
match or with a null text have no rows; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import materialize

#: Documents and postings of one shard, and query text per block (all bounds
#: of task and driver memory; none changes a result).
SHARD_DOCS = 8192
SHARD_POSTINGS = 2_000_000
BLOCK_BYTES = 16_000_000
BLOCK_ITEMS = 20_000

#: Bytes of terms: digits, letters and everything beyond ASCII; A-Z is lower-cased.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, UTF-8."""
    return (text or "").encode("utf-8").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_blocks(items: DataFrame, block_bytes: int, block_items: int):
    """The distinct items in blocks: lists of (qid, {term: repeats}).  Blocks
    are cut by a running size per id range, read one after another."""
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-size // block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "text").collect()
        yield [(r["qid"], dict(Counter(terms_of(r["text"])))) for r in rows]


def _statistics(texts: DataFrame, terms: dict[bytes, int], shared) -> tuple[int, int, dict[int, int]]:
    """(N, L, df by term number) over all texts."""
    schema = "term int, c long"

    def run(batches):
        known, df = shared.value, np.zeros(len(terms), np.int64)
        n_docs = total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = terms_of(text)
                n_docs += bool(words)
                total += len(words)
                found = known.keys() & set(words)
                if found:
                    df[[known[t] for t in found]] += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(([-2, -1], hit)), pa.int32()), pa.array(np.concatenate(([n_docs, total], df[hit])), pa.int64())],
            names=["term", "c"],
        )

    rows = texts.mapInArrow(run, schema).groupBy("term").agg(F.sum("c").alias("c")).collect()
    counts = {r["term"]: r["c"] for r in rows}
    return counts.pop(-2, 0), counts.pop(-1, 0), counts


class Shard:
    """Postings of the query terms over a bounded run of documents, numbered
    by ascending id."""

    def __init__(self, ids: pa.Array, lengths, doc, term, tf, n_docs: int, total: int):
        order = pc.array_sort_indices(ids, null_placement="at_end")
        self.ids = ids.take(order)
        place = np.empty(len(ids), np.int64)
        place[order.to_numpy()] = np.arange(len(ids))
        lengths = np.array(lengths, np.int64)
        # Exact at any size: the product may pass 64 bits.
        norm = np.array([25 + (75 * n * n_docs) // total for n in lengths.tolist()], np.int64) if total else lengths
        doc, term, tf = (np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64) for a in (doc, term, tf))
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[doc])
        by_term = np.argsort(term, kind="stable")
        self.doc, self.impact = place[doc][by_term], impact[by_term]
        self.terms, self.starts = np.unique(term[by_term], return_index=True)
        self.ends = np.append(self.starts[1:], len(by_term))
        self.best = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else self.impact
        self.at = {t: i for i, t in enumerate(self.terms.tolist())}
        self.size = len(ids)
        self.accumulators = 0  # of the last query

    def rank(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (numbers, scores) for (term, weight with
        repeats) in order of rarity."""
        here = [(self.at[t], w) for t, w in query if t in self.at and w > 0]
        acc = np.zeros(self.size, np.int64)
        alive = np.zeros(self.size, bool)
        rest = sum(w * int(self.best[i]) for i, w in here)
        creating, n_alive = True, 0
        for i, w in here:
            # acc is 0 without an accumulator, so its k largest are those of the accumulators.
            if creating and n_alive >= k and rest < np.partition(acc, self.size - k)[self.size - k]:
                creating = False
            doc, part = self.doc[self.starts[i]:self.ends[i]], w * self.impact[self.starts[i]:self.ends[i]]
            if creating:
                acc[doc] += part
                alive[doc] = True
                n_alive = int(np.count_nonzero(alive))
            else:
                own = alive[doc]
                acc[doc[own]] += part[own]
            rest -= w * int(self.best[i])
        self.accumulators = n_alive
        found = np.flatnonzero(acc)
        top = found[np.lexsort((found, -acc[found]))][:k]
        return top, acc[top]


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = SHARD_DOCS,
    shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    distinct = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    # A number per item, fixed by writing it once.
    queries = materialize(distinct.withColumn("qid", F.monotonically_increasing_id()), "search-items")
    schema = T.StructType([
        T.StructField("qid", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType()),
    ])
    best = None
    for block in item_blocks(queries, block_bytes, block_items):
        terms = {t: i for i, t in enumerate(sorted({t for _, q in block for t in q}))}
        shared = spark.sparkContext.broadcast(terms)
        n_docs, total, df = _statistics(own.select("text"), terms, shared)
        weights = {i: weight(n_docs, n) for i, n in df.items()}
        plan = [(qid, [(t, weights[t] * rep) for n, t, rep in sorted((df[terms[w]], terms[w], c) for w, c in q.items() if terms[w] in df)])
                for qid, q in block]
        plan = spark.sparkContext.broadcast(plan)
        part = materialize(own.mapInArrow(_ranker(shared, plan, n_docs, total, k, shard_docs, shard_postings, schema), schema), "search-shards")
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(queries.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")


def _ranker(shared, plan, n_docs, total, k, shard_docs, shard_postings, schema):
    def results(shard: Shard):
        for qid, query in plan.value:
            top, scores = shard.rank(query, k)
            if len(top):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top), qid), pa.int64()), shard.ids.take(pa.array(top)), pa.array(scores, pa.int64())], names=schema.names
                )

    def run(batches):
        known = shared.value

        def fresh():
            return [], array("q"), array("q"), array("q"), array("q")

        def flush():
            rows = list(results(Shard(pa.concat_arrays(ids), lengths, doc, term, tf, n_docs, total)))
            if rows:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]

        ids, lengths, doc, term, tf = fresh()
        for batch in batches:
            own, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            for i, text in enumerate(texts):
                words = terms_of(text)
                counts = Counter(w for w in words if w in known)
                at = len(lengths)
                lengths.append(len(words))
                doc.extend([at] * len(counts))
                term.extend(known[w] for w in counts)
                tf.extend(counts.values())
                if len(lengths) >= shard_docs or len(tf) >= shard_postings:
                    ids.append(own.slice(begin, i + 1 - begin))
                    begin = i + 1
                    yield from flush()
                    ids, lengths, doc, term, tf = fresh()
            if begin < len(texts):
                ids.append(own.slice(begin))
        if ids:
            yield from flush()

    return run
