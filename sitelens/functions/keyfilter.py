"""Fixed-size membership filter of string keys (a Bloom filter).

``key_filter`` sets four bits per key with a partial aggregate: tasks or
together the 64-bit words of their keys, so at most ``bits / 64`` rows leave a
task, whatever the number of keys.  The result is one row with the words of
the filter, ``bits / 8`` bytes.  ``may_contain`` tests a column against it with
native expressions inside the scan's stage (an uncorrelated scalar subquery,
run once); ``filter_words`` and ``contains`` are the same test in a Python
worker, for whole arrays of keys.

A filter never misses a key.  It lets some others through, so an exact join
(or exact counting) follows wherever it is used.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import materialize

PROBES = 4
#: Bits per expected key (about 0.3 % pass by chance at four probes) and the
#: bounds of a filter: 8 KB to 8 MB.
BITS_PER_KEY = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26
_HALF = (1 << 32) - 1


def filter_bits(n_keys: int) -> int:
    """A power of two for so many keys, within the bounds."""
    bits = MIN_BITS
    while bits < min(n_keys * BITS_PER_KEY, MAX_BITS):
        bits *= 2
    return bits


def _positions(h: Column, bits: int) -> list[Column]:
    """Bit positions of a 64-bit hash: double hashing with its halves."""
    low, high = h.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(low + F.lit(i) * high).bitwiseAND(F.lit(bits - 1)) for i in range(PROBES)]


def hash_filter(keys: DataFrame, h: str, bits: int) -> DataFrame:
    """One row: ``words`` array<bigint> of the filter over the 64-bit hashes
    in column ``h`` (nulls are left out)."""
    at = keys.filter(F.col(h).isNotNull()).select(F.explode(F.array(*_positions(F.col(h), bits))).alias("p"))
    word = at.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")
    )
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    full = word.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = full.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("ws"))
    return materialize(one.select(F.col("ws.b").alias("words")), "key-filter")


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``hash_filter`` of the XXH64 of a column (nulls are left out)."""
    return hash_filter(keys.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")), "h", bits)


def may_contain_hash(words: DataFrame, h: Column, bits: int) -> Column:
    """Condition: the hash may be in the filter (never false for one that is)."""
    array = words.scalar()
    out = h.isNotNull()
    for p in _positions(h, bits):
        word = F.get(array, F.shiftright(p, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int"))
        out = out & (bit.bitwiseAND(F.lit(1)) == 1)
    return out


def may_contain(words: DataFrame, key: Column, bits: int) -> Column:
    """Condition: the key may be in the filter (never false for one that is)."""
    return key.isNotNull() & may_contain_hash(words, F.xxhash64(key), bits)


def filter_words(words: DataFrame) -> np.ndarray:
    """The filter for Python workers (its size is fixed, see MAX_BITS)."""
    return np.array(words.first()[0], np.int64).view(np.uint64)


def contains(filter_words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``may_contain`` for an array of unsigned hashes (``key_hashes``)."""
    low, high = hashes & np.uint64(_HALF), (hashes >> np.uint64(32)) | np.uint64(1)
    out = np.ones(len(hashes), bool)
    for i in range(PROBES):
        p = (low + np.uint64(i) * high) & np.uint64(64 * len(filter_words) - 1)
        out &= (filter_words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def key_hashes(keys) -> np.ndarray:
    """XXH64 of UTF-8 keys, as the SQL function has it (seed 42)."""
    return np.fromiter((xxhash.xxh64_intdigest(k, seed=42) for k in keys), np.uint64)
