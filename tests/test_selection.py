import math
import random
import statistics

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from asfiled.operators.selection import exact_medians, values_at_ranks, with_ntile


def sample(spark, n=2000):
    """Two thirds of the rows share one group, and half of those one value."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]),
             0.0 if rng.random() < 0.5 else round(rng.gauss(0, 1), 2), i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double, i int").repartition(7)


def values_by_group(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    return {g: sorted(v for v in values if v is not None) for g, values in groups.items()}


# By lists alone, by ranges alone.
@pytest.mark.parametrize("bins, few", [(8, 10**6), (256, 0)])
def test_every_rank_equals_the_sorted_list(spark, bins, few):
    df = sample(spark)
    ranks = {"first": F.lit(1), "third": F.lit(3), "fifth": F.ceil(F.col("group_rows") / 5),
             "last": F.col("group_rows"), "none": F.col("group_rows") + 1, "zero": F.lit(0)}
    want = values_by_group(df)
    got = values_at_ranks(df, ["g"], "v", ranks, bins, few).collect()
    assert sorted((str(r.g), r.rank) for r in got) == sorted(
        (str(g), name) for g in want for name in ("first", "third", "fifth", "last"))
    for r in got:
        ordered = want[r.g]
        assert r.group_rows == len(ordered) and r.value == ordered[r["at"] - 1]
        assert r.below == sum(x < r.value for x in ordered)
        assert r.equal == ordered.count(r.value)


@pytest.mark.parametrize("values, few", [
    ([-math.inf, -1.7e308, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.7e308, math.inf], 20),
    ([-math.inf, 0.0, 0.999, 1.0, 1.0000000000000002, 1.0000000000000002, math.inf, math.inf], 0)])
def test_extreme_values(spark, values, few):
    df = spark.createDataFrame([(v,) for v in values + [math.nan, None]], "v double")
    ranks = {str(i): F.lit(i + 1) for i in range(len(values) + 2)}
    got = {int(r.rank): r.value for r in values_at_ranks(df, [], "v", ranks, few=few).collect()}
    assert [got[i] for i in range(len(values))] == values
    assert math.isnan(got[len(values)]) and len(got) == len(values) + 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert values_at_ranks(df, ["g"], "v", {"m": F.lit(1)}).isEmpty()
    assert with_ntile(df, ["g"], "v", [], 5, "t").isEmpty()


def test_medians_equal_brute_force(spark):
    df = sample(spark, 501)
    got = {r.g: r.m for r in exact_medians(df, ["g"], "v", "m").collect()}
    assert got == {g: statistics.median(v) for g, v in values_by_group(df).items()}


@pytest.mark.parametrize("rows, tiles, group", [(2000, 5, ["g"]), (300, 7, []), (9, 10, ["g"])])
def test_tiles_equal_sql(spark, rows, tiles, group):
    df = sample(spark, rows)
    got = with_ntile(df, group, "v", ["i"], tiles, "t")
    want = df.withColumn("t", F.ntile(tiles).over(W.partitionBy(*group).orderBy("v", "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rows_do_not_move_unless_a_tile_begins_among_equal_values(spark):
    apart = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v", "id as i")
    tiled = with_ntile(apart, ["g"], "v", ["i"], 5, "t")
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "rangepartitioning" not in plan
