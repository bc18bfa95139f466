from pyspark.sql import functions as F

from tamarack.sources.listing import rank_all


def test_rank_all_over_many_partitions(spark):
    """Every row gets a rank of its own, in order, however the rows are split."""
    n = 400_000
    df = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), F.lit("x").alias("rank_of"))
    got = rank_all(df, [F.col("score").desc(), F.col("id")])
    s = got.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    assert (s.n, s.d, s.lo, s.hi) == (n, n, 1, n)
    by = got.select("rank", "score", "id").sort("rank").toPandas()
    assert by[["score", "id"]].equals(by[["score", "id"]].sort_values(["score", "id"], ascending=[False, True], ignore_index=True))
    assert rank_all(df.limit(0), [F.col("id")]).count() == 0
