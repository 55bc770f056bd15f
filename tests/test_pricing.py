import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asfiled.operators.pricing import fold_prices, with_close


def brute(prices, ticker, day, direction):
    reach = range(0, 11)
    for step in reach:
        d = day - dt.timedelta(step) if direction == "backward" else day + dt.timedelta(step)
        closes = [c for t, p, c in prices if t == ticker and p == d]
        if closes:
            return d, max(closes)
    return None, None


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_equals_brute_force(spark, direction):
    rng = random.Random(11)
    first = dt.date(1969, 11, 20)
    prices = [(t, first + dt.timedelta(rng.randint(0, 400)), float(rng.randint(1, 99)))
              for t in ("A", "B", "C") for _ in range(60)]
    asked = [(i, rng.choice(["A", "B", "C", "none", None]),
              first + dt.timedelta(rng.randint(-15, 415))) for i in range(400)]
    table = spark.createDataFrame(prices, "ticker string, price_date date, close double")
    left = spark.createDataFrame(asked, "i int, ticker string, day date")
    got = with_close(left, fold_prices(table), F.col("day"), direction, "found", "close")
    assert {(r.i, r.found, r.close) for r in got.collect()} == {
        (i, *brute(prices, t, d, direction)) for i, t, d in asked}


def test_friday_is_found_and_eleven_days_is_too_far(spark):
    table = spark.createDataFrame([("A", dt.date(2016, 12, 30), 5.0)],
                                  "ticker string, price_date date, close double")
    left = spark.createDataFrame([("A", dt.date(2017, 1, 1)), ("A", dt.date(2017, 1, 9)),
                                  ("A", dt.date(2017, 1, 10))], "ticker string, day date")
    got = with_close(left, fold_prices(table), F.col("day"), "backward", "found", "close")
    assert sorted((r.day.day, r.close) for r in got.collect()) == [
        (1, 5.0), (9, 5.0), (10, None)]


def test_copies_of_a_price_do_not_multiply_rows(spark):
    table = spark.createDataFrame([("A", dt.date(2016, 12, 30), 5.0)] * 50,
                                  "ticker string, price_date date, close double")
    left = spark.createDataFrame([("A", dt.date(2017, 1, 1))] * 20, "ticker string, day date")
    got = with_close(left, fold_prices(table), F.col("day"), "backward", "found", "close")
    assert got.count() == 20

