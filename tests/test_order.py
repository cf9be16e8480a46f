"""Distributed dense positions equal a per-group row_number."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbiter.operators.order import dense_position


def test_dense_position_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 5003).alias("k"), "id").repartition(9)
    got = dense_position(df, ["g"], ["k", "id"], num_partitions=5)
    want = df.withColumn("row_pos", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")))
    a = sorted(tuple(r) for r in got.select("g", "id", "row_pos").collect())
    b = sorted(tuple(r) for r in want.select("g", "id", "row_pos").collect())
    assert a == b


def test_dense_position_without_groups(spark):
    df = spark.range(0, 100).select((F.col("id") * 37 % 101).alias("k"))
    got = sorted(r["row_pos"] for r in dense_position(df, [], ["k"], num_partitions=3).collect())
    assert got == list(range(1, 101))


def test_dense_position_consistent_under_adaptive_coalescing(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = spark.range(0, 200000).select((F.col("id") % 50).alias("g"), (F.col("id") * 7919 % 200003).alias("k"), "id")
        got = dense_position(df.repartition(13), ["g"], ["k", "id"])
        agg = got.groupBy("g").agg(F.count("*").alias("n"), F.min("row_pos").alias("lo"), F.max("row_pos").alias("hi"),
                                   F.countDistinct("row_pos").alias("d")).collect()
        assert len(agg) == 50 and all(r["n"] == 4000 and r["lo"] == 1 and r["hi"] == 4000 and r["d"] == 4000 for r in agg)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
