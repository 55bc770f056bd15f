import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from asfiled.operators.ranking import ntile_of, number_rows


def sample(spark, n=3000):
    """Two thirds of the rows share one group, and half of those one value."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]),
             0.0 if rng.random() < 0.5 else round(rng.gauss(0, 1), 2), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, i int").repartition(7)


def test_row_numbers_equal_the_window(spark):
    df = sample(spark)
    got = number_rows(df, ["g"], [F.col("v"), F.col("i")])
    w = W.partitionBy("g")
    want = df.withColumn("row_number", F.row_number().over(w.orderBy("v", "i")).cast("long")) \
        .withColumn("group_rows", F.count("*").over(w))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_global_row_numbers(spark):
    got = number_rows(sample(spark), [], [F.col("v").desc(), F.col("i")])
    rows = sorted(got.collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in rows] == list(range(1, 3001))
    assert rows == sorted(rows, key=lambda r: (-r.v, r.i))


def test_ntile_equals_sql_for_every_small_size(spark):
    rows = [(n, i) for n in range(1, 23) for i in range(n)]
    df = spark.createDataFrame(rows, "n int, i int")
    got = number_rows(df, ["n"], [F.col("i")]).withColumn("t", ntile_of(5))
    want = df.withColumn("t", F.ntile(5).over(W.partitionBy("n").orderBy("i")))
    assert sorted(map(tuple, got.select("n", "i", "t").collect())) == sorted(
        map(tuple, want.collect()))
