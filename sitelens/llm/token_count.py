"""Token counts by byte-pair merging, without emitting identifiers.

Each pre-token becomes a linked list of byte symbols and a heap of adjacent
pairs ordered by (merge rank, position).  The lowest-rank pair is popped and
joined until no pair is left; the count is the number of initial symbols
minus the number of merges.  Counts of short pre-tokens are memoised per
worker (bounded).  The job is map-only: no shuffle, any skew of sources or
groups of copies has no effect, and a lost task is simply run again.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows give repeated results; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelens.llm.common import Memo, doc_fields, tokenizer_path, vocabulary_bytes
from sitelens.llm.pretoken import Pieces


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the other
    bytes take the code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def load_merges(raw: bytes) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]], list[str]]:
    """(symbol of each byte, (left, right) -> (rank, joined), special strings)."""
    spec = json.loads(raw)
    model = spec["model"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE vocabulary")
    if spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("vocabularies with a prefix space are not supported")
    special = [t["content"] for t in spec.get("added_tokens", [])]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens that strip or need word borders are not supported")
    ids = model["vocab"]
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
    return [ids[c] for c in byte_alphabet()], pairs, special


def merged_length(symbols: list[int], pairs: dict) -> int:
    """Symbols left after all merges, lowest rank first, leftmost on ties."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = pairs.get
    heap = []
    for i in range(n - 1):
        hit = get((symbols[i], symbols[i + 1]))
        if hit:
            heap.append((hit[0], i, symbols[i], symbols[i + 1], hit[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right, joined = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = joined, -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = get((joined, symbols[k]))
            if hit:
                heapq.heappush(heap, (hit[0], i, joined, symbols[k], hit[1]))
        h = before[i]
        if h >= 0:
            hit = get((symbols[h], joined))
            if hit:
                heapq.heappush(heap, (hit[0], h, symbols[h], joined, hit[1]))
    return n - merges


class Counter:
    """Counts the tokens of whole texts for one vocabulary."""

    def __init__(self, raw: bytes):
        symbols, pairs, special = load_merges(raw)
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = Pieces()
        self.memo = Memo(lambda p: merged_length([symbols[b] for b in p.encode("utf-8")], pairs))

    def plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.pieces.of(text)))

    def count(self, text: str) -> int:
        if self.split is None:
            return self.plain(text)
        parts = self.split.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


def token_counts(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 512,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-level BPE ``.json`` file, read on
    the driver and broadcast (a published vocabulary has a fixed size).
    Strings of special tokens inside a text count as one token each.
    """
    raw = docs.sparkSession.sparkContext.broadcast(
        vocabulary_bytes(vocabulary or tokenizer_path("byte_bpe_50k.json"))
    )
    schema = doc_fields(
        docs, id_col, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    )

    def run(batches):
        counter = Counter(raw.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8")) for t in texts]
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > max_tokens for c in counts], pa.bool_())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
