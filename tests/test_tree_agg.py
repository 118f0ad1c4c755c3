from pyspark.sql import functions as F

from quire.operators.tree_agg import heavy_keys, rounds_for, tree_aggregate, tree_distinct_count


def test_equals_plain_aggregate(spark):
    df = spark.range(20_000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("int")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"), F.lit(1).alias("node")).repartition(5)
    measures = {"n": ("count", F.lit(1)), "c": ("count", F.col("v")), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v"))}
    got = tree_aggregate(df, {"k": F.col("k")}, measures, chunk_rows=100, fan_in=3, rounds=4)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nulls_ties_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None), (None, 1), (2, None), (2, None)], "k int, n int")
    got = {r.n: (r.c, r.k) for r in tree_aggregate(df, {"n": F.col("k")}, {"c": ("count", F.col("n")), "k": ("max", F.col("n"))}).collect()}
    assert got == {None: (1, 1), 2: (0, None)}


def test_distinct_count(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, None), (3, 1)], "k int, v int")
    assert {r.k: r.n for r in tree_distinct_count(df, {"k": F.col("k")}, F.col("v"), "n").collect()} == {1: 2, 3: 1}


def test_heavy_keys_is_strict_and_counts_null_keys_in_the_total(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(2,)] * 4 + [(None,)] * 10 + [(i,) for i in range(10, 91)], "k int")
    assert {(r.key, r.n) for r in heavy_keys(df, "k", 4).collect()} == {(1, 5)}


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert tree_aggregate(df, {"k": F.col("k")}, {"n": ("count", F.lit(1))}).count() == 0
    assert heavy_keys(df, "k", 4).count() == 0


def test_rounds():
    assert rounds_for(0, 16) == rounds_for(16, 16) == 1
    assert rounds_for(4096, 16) == 3
