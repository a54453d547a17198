"""Corpus pipeline: five stages of the corpus operators over ``documents``.

Each stage reads the rows its predecessor kept (written as Parquet under the
shared folder and read again).  All but the last return the columns of
``documents``, further columns included; the last returns the token ids of
what is left.

Defined results: rows with a null or empty text are rejected by the quality
rules; rows with a null id take part in every stage; rows that repeat both id
and text leave one row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import bpe_codec, decontaminate, quality, secret_scan, simhash
from sitelens.llm.common import documents, materialize, prepare_session, table
from sitelens.llm.spans import redacted

MASK = "[SECRET]"
#: Stages that train models or match thresholds learned from the rows cannot
#: be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    prepare_session(spark)
    names = docs.columns
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"), columns=names)
    return judged.filter("kept").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of their text, under a name that is still free."""
    taken = {c.lower() for c in docs.columns}
    name = "text_key"
    while name in taken:
        name += "_"
    return docs.withColumn(name, F.xxhash64("text")), name


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every SimHash component: its smallest doc_id (nulls last).
    Rows that repeat both id and text count once."""
    prepare_session(spark)
    found = simhash.near_duplicates(docs, shingle=4, radius=4, text_key=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "fingerprint")
    kept = materialize(found.groupBy("root").agg(F.min(order).alias("r")).select("r.doc_id", "r.text_key"), "pipeline-kept").distinct()
    repeated = not found.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    own, key = _keyed(docs)
    rows = own.join(kept, own["doc_id"].eqNullSafe(kept["doc_id"]) & (own[key] == kept["text_key"]), "left_semi")
    if repeated:
        first = rows.groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias("r"))
        return first.select(*[F.col("r")[c].alias(c) for c in docs.columns])
    return rows.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by a benchmark item."""
    prepare_session(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("t")
    ).distinct()
    own, key = _keyed(docs)
    return own.join(found, own["doc_id"].eqNullSafe(found["d"]) & (own[key] == found["t"]), "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are masked and n_chars follows."""
    prepare_session(spark)
    names = docs.columns
    found = secret_scan.secret_spans(docs, columns=names, folds=secret_scan.FOLDS)
    clean = F.when(F.col("in_text").isNull(), F.lit(None)).otherwise(redacted(F.col("text"), F.col("spans"), MASK))
    out = found.withColumn("clean", clean)
    changed = F.size("spans") > 0
    return out.select(*[
        F.col("clean").alias(c) if c == "text"
        else F.when(changed, F.char_length("clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"in_{c}")).alias(c)
        if c == "n_chars" else F.col(f"in_{c}").alias(c)
        for c in names
    ])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with digests of ids and decoded bytes."""
    prepare_session(spark)
    return bpe_codec.encode_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("SimHash near-dedup", keep_one_per_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
