"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a pre-token are read as Latin-1, so an Aho-Corasick automaton
over the vocabulary finds every token occurrence.  The encoder takes the
longest token at the current position; if it cannot stand next to the token
before it, the next shorter one is tried, and when none is left the last
token is given up.  Positions from which the rest cannot be encoded are
marked, so each (position, token) is looked at once and the time is linear
in the text.  Two tokens may be neighbours exactly when merging their joined
bytes gives the two tokens back; that test is memoised per pair.

The job is map-only.  Defined results: a null text is empty (no ids); repeated
rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelens.llm.common import MEMO_ENTRIES, Memo, doc_fields, tokenizer_path, vocabulary_bytes
from sitelens.llm.pretoken import BYTE_LEVEL, Pieces


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.splitlines()))}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain merging of a short byte string: join the adjacent parts of the
    lowest rank (leftmost on ties) until none is in the vocabulary."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(
            ((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None
        )
        if best is None:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_LEVEL):
        self.ranks = ranks
        self.pieces = Pieces(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            # A token that merging its own bytes does not give back can only
            # be a whole pre-token; it never takes part in a longer one.
            if merge_by_rank(token, ranks) == [token]:
                self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pair: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.memo = Memo(lambda piece: np.array(self.encode_piece(piece.encode("utf-8")), "<u4").tobytes())

    def spine(self, rank: int) -> tuple[list, list]:
        """Parts of a token that touch its right and its left edge while it
        is merged, each with the rank of the merge that ends the part."""
        known = self.spines.get(rank)
        if known is None:
            data = self.bytes_of[rank]
            parts = [data[i:i + 1] for i in range(len(data))]
            last, first = parts[-1], parts[0]
            right, left = [], []
            while len(parts) > 1:
                at, i = min((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                if parts[-1] != last:
                    right.append((last, at))
                    last = parts[-1]
                if parts[0] != first:
                    left.append((first, at))
                    first = parts[0]
            known = self.spines[rank] = (right + [(last, self.size)], left + [(first, self.size)])
        return known

    def neighbours(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``: merging their joined bytes never
        merges across the border.  A merge across it joins a part at the right
        edge of the one with a part at the left edge of the other, and takes
        place if its rank comes before the merges that end these parts (on
        ties the leftmost merge comes first)."""
        key = left * self.size + right
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) >= 2 * MEMO_ENTRIES:
                self.pair.clear()
            get = self.ranks.get
            ends, starts = self.spine(left)[0], self.spine(right)[1]
            known = True
            for x, x_end in ends:
                for y, y_end in starts:
                    across = get(x + y)
                    if across is not None and across < x_end and across <= y_end:
                        known = False
                        break
                if not known:
                    break
            self.pair[key] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        # Token lengths by start position, longest last.
        fits: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(data.decode("latin-1")):
            fits[end + 1 - length].append(length)
        ids: list[int] = []
        tried: list[list[int]] = []  # lengths still open at each taken token
        dead = bytearray(n + 1)
        at = 0
        open_here = sorted(fits[0]) if n else []
        while at < n:
            while open_here:
                length = open_here.pop()
                if dead[at + length]:
                    continue
                token = self.ranks[data[at:at + length]]
                if not ids or self.neighbours(ids[-1], token):
                    ids.append(token)
                    tried.append(open_here)
                    at += length
                    open_here = sorted(fits[at]) if at < n else []
                    break
            else:
                dead[at] = 1
                at -= len(self.bytes_of[ids.pop()])
                open_here = tried.pop()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces.of(text)))

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[int, int, str], Codec] = {}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """One codec per worker process; building it takes a second or two."""
    key = (len(raw), hash(raw), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(load_ranks(raw), pattern)
    return _CODECS[key]


def encode_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = BYTE_LEVEL,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array<int>, if
    ``keep_ids``), ids_sha256, decoded_sha256 and round_trip (the decoded
    bytes equal the text's)."""
    raw = docs.sparkSession.sparkContext.broadcast(
        vocabulary_bytes(vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    )
    fields = [
        T.StructField("n_tokens", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    schema = doc_fields(docs, id_col, *fields)

    def run(batches):
        codec = codec_of(raw.value, pattern)
        for batch in batches:
            counts, ids, digests, decoded, same = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                packed = codec.encode(text)
                back = codec.decode(packed)
                counts.append(len(packed) // 4)
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                same.append(back == text.encode("utf-8"))
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            columns += [pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
