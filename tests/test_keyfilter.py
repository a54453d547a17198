"""The fixed-size key filter: no key is missed, few others pass, both tests agree."""

from pyspark.sql import functions as F

from sitelens.functions import keyfilter as K


def test_no_key_is_missed_and_both_forms_agree(spark):
    keys = spark.range(4000).select(F.concat(F.lit("https://example.org/é/"), "id").alias("k"))
    bits = K.filter_bits(4000)
    words = K.key_filter(keys.union(spark.sql("SELECT CAST(NULL AS STRING)")), "k", bits)
    probe = spark.range(40_000).select(F.concat(F.lit("https://example.org/é/"), "id").alias("k"), (F.col("id") < 4000).alias("own"))
    rows = probe.withColumn("passed", K.may_contain(words, F.col("k"), bits)).collect()
    raw = K.filter_words(words)
    assert raw.nbytes == bits // 8
    assert all(r.passed for r in rows if r.own)
    assert sum(r.passed for r in rows if not r.own) < 0.01 * 36_000
    assert [r.passed for r in rows] == K.contains(raw, K.key_hashes(r.k.encode() for r in rows)).tolist()
    assert not spark.sql("SELECT CAST(NULL AS STRING) AS k").filter(K.may_contain(words, F.col("k"), bits)).count()


def test_empty_filter_and_bounds(spark):
    none = spark.range(0).select(F.col("id").cast("string").alias("k"))
    bits = K.filter_bits(0)
    words = K.key_filter(none, "k", bits)
    assert spark.range(100).filter(K.may_contain(words, F.col("id").cast("string"), bits)).count() == 0
    assert K.filter_bits(0) == K.MIN_BITS and K.filter_bits(10**12) == K.MAX_BITS
