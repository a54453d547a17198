"""Operators 3 and 5 against the tokenizer libraries."""

import array
import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sitelens.llm.bpe_codec import Codec, encode_documents, load_ranks, merge_by_rank
from sitelens.llm.pretoken import Pieces
from sitelens.llm.token_count import Counter, token_counts

ALPHABET = "abcdeéèst ñ 1 23\n\t'\x1c\x85<|endoftext|>%%$日本語\U00016ed0"


def texts():
    rnd = random.Random(3)
    out = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    out += [a + "<|endoftext|>" + a for a in out[:40]]
    out += ["".join(chr(rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(80)) for _ in range(100)]
    return out + ["", "a" * 5000, "ab" * 3000, "é" * 2000, "x" + " " * 2000 + "y", "\n" * 999]


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return Codec(load_ranks(f.read()))


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    with open(P.path("byte_bpe_50k.json"), "rb") as f:
        counter = Counter(f.read())
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_ids_equal_the_library_and_round_trip(codec, reference):
    for text in texts():
        packed = codec.encode(text)
        assert list(array.array("I", packed)) == reference.encode_ordinary(text), text[:80]
        assert codec.decode(packed) == text.encode()


def test_neighbours_equal_merging(codec):
    rnd = random.Random(2)
    for _ in range(20_000):
        a, b = rnd.randrange(codec.size), rnd.randrange(codec.size)
        x, y = codec.bytes_of[a], codec.bytes_of[b]
        assert codec.neighbours(a, b) == (merge_by_rank(x + y, codec.ranks) == [x, y])


def test_pattern_equals_the_published_one():
    from sitelens.llm.pretoken import BYTE_LEVEL

    assert BYTE_LEVEL == P.PATTERN
    assert "".join(Pieces().of("a\U00016ed0 b")) == "a\U00016ed0 b"


def test_edge_rows(edge_docs, no_docs, reference):
    counts = token_counts(edge_docs).collect()
    assert len(counts) == edge_docs.count()
    by_id = {r.doc_id: r for r in counts}
    assert (by_id[1].n_bytes, by_id[1].n_tokens, by_id[1].over_limit) == (0, 0, False)
    assert by_id[2].n_tokens == 0 and by_id[7].over_limit
    assert sum(r.doc_id == 5 for r in counts) == 2
    coded = {r.doc_id: r for r in encode_documents(edge_docs).collect()}
    assert coded[1].ids == [] and coded[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert coded[8].ids == reference.encode_ordinary("\U0001f600 é" * 20)
    assert all(r.round_trip for r in coded.values())
    assert token_counts(no_docs).count() == 0 and encode_documents(no_docs).count() == 0
