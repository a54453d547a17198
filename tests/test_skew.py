"""skew_join equals a plain join and deals hot keys to several salts."""

from pyspark.sql import functions as F

from sitelens.functions.skew import skew_join


def test_equals_plain_join(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"),
        F.col("id"),
    )
    side = rows.filter("id % 2 = 0").groupBy("k").agg(F.max("id").alias("m")).filter("k IS NOT NULL")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "k", how).collect()))
        assert sorted(map(str, skew_join(rows, side, "k", how).collect())) == want
        counts = rows.groupBy("k").count()
        assert sorted(map(str, skew_join(rows, side, "k", how, counts).collect())) == want
    plan = skew_join(rows, side, "k")._jdf.queryExecution().toString()
    assert "salt" in plan and "salt" not in skew_join(rows.filter("k <> 'hot'"), side, "k")._jdf.queryExecution().toString()
    assert skew_join(rows.filter("false"), side, "k").count() == 0
