"""As-of price lookup without a range join.

Prices are folded to one row per (ticker, bucket of consecutive days) holding the bucket's closes
by day. A search window is exactly one bucket long, so it touches two neighbouring buckets: two
equi-joins that match at most one row each find every candidate. The fold is a map-side combined
hash aggregate (a bucket of daily prices becomes one shuffled row), repeated price rows cannot
multiply the other side, and a ticker with very many rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def fold_prices(prices: DataFrame, days: int = fixed.PRICE_TOLERANCE_DAYS + 1) -> DataFrame:
    """(ticker, bucket, closes): ``closes[i]`` is the close of the bucket's day ``i``, or null.

    Of several closes for one ticker and day the highest is kept.
    """
    placed = prices.selectExpr(
        "ticker", "close", f"floor(unix_date(price_date) / {days}) as bucket",
        f"pmod(unix_date(price_date), {days}) as _day")
    daily = [F.expr(f"max(if(_day = {d}, close, null)) as _c{d}") for d in range(days)]
    closes = ", ".join(f"_c{d}" for d in range(days))
    return placed.groupBy("ticker", "bucket").agg(*daily).selectExpr(
        "ticker", "bucket", f"array({closes}) as closes")


def with_close(left: DataFrame, folded: DataFrame, day: Column, direction: str,
               date_name: str, close_name: str,
               tolerance: int = fixed.PRICE_TOLERANCE_DAYS) -> DataFrame:
    """Add the close nearest to ``day``: the last one in ``[day - tolerance, day]`` for
    ``direction="backward"``, the first one in ``[day, day + tolerance]`` for ``"forward"``.

    Every row of ``left`` is kept exactly once. ``folded`` must have been folded with
    ``tolerance + 1`` days.
    """
    width = tolerance + 1
    start = F.unix_date(day) - (tolerance if direction == "backward" else 0)
    probe = left.withColumn("_start", start).withColumn(
        "_bucket", F.expr(f"floor(_start / {width})"))
    here = folded.selectExpr("ticker as _t0", "bucket as _b0", "closes as _closes0")
    following = folded.selectExpr("ticker as _t1", "bucket as _b1", "closes as _closes1")
    found = (probe.join(here, F.expr("ticker = _t0 and _bucket = _b0"), "left")
             .join(following, F.expr("ticker = _t1 and _bucket + 1 = _b1"), "left"))

    blank = f"array_repeat(cast(null as double), {width})"
    both = f"concat(coalesce(_closes0, {blank}), coalesce(_closes1, {blank}))"
    window = f"slice({both}, cast(_start - _bucket * {width} + 1 as int), {width})"
    dated = (f"transform({window}, (close, i) -> if(close is null, null, "
             "struct(cast(_start + i as int) as day, close)))")
    pick = "array_max" if direction == "backward" else "array_min"
    return found.withColumn("_hit", F.expr(f"{pick}({dated})")).selectExpr(
        *left.columns, f"date_from_unix_date(_hit.day) as {date_name}",
        f"_hit.close as {close_name}")
