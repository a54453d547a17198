"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sitelens.session import ensure_checkpoint_dir, materialize, prepare_session

#: Bound of each of the two generations of a per-worker memo of distinct
#: pieces (entries), so worker memory stays flat on any input.
MEMO_ENTRIES = 400_000
#: Only pieces up to this many characters are kept in a memo.
MEMO_PIECE = 64

#: Letters lower-cased by the contracts: A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Memo(dict):
    """``memo[piece]`` computes ``fn(piece)`` once; bounded in entries.  A
    full generation becomes the old one, from which pieces still in use move
    over again."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn
        self.old: dict = {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.fn(piece)
            if len(piece) > MEMO_PIECE:
                return value
        self.store(piece, value)
        return value

    def store(self, piece, value) -> None:
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[piece] = value


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a folder, session options applied."""
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file (its size is fixed by the published tokenizer)."""
    with open(path, "rb") as f:
        return f.read()


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; ``SITELENS_TOKENIZERS`` names
    another folder."""
    folder = os.environ.get("SITELENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def doc_fields(docs: DataFrame, id_col: str, *fields: T.StructField) -> T.StructType:
    """Output schema: the id with its own type, then ``fields``."""
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields])


__all__ = [
    "MEMO_ENTRIES", "Memo", "UPPER", "doc_fields", "documents", "ensure_checkpoint_dir", "materialize",
    "prepare_session", "table", "tokenizer_path", "vocabulary_bytes",
]
