"""Order statistics by narrowing histograms: the value at a rank, found without sorting rows.

For every wanted rank the rows of its group are counted in equal ranges between the smallest and
the largest value; the range that holds the rank becomes the next one, until it holds one value
or few enough to be put in order as they are. A pass shuffles one row per task, group and range
that has rows, whatever the number of rows or of equal values; the rows themselves stay.

Every pass reads the grouping columns and the value of ``df`` again, so ``df`` should be a scan
of a written table, not a plan that is costly to repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import materialise
from .ranking import ntile_of, number_rows
from .volume import match

#: Ranges that a pass cuts the values between two bounds into.
BINS = 1024
#: Values between two bounds that are gathered and put in order instead of being cut once more.
FEW = 4096

_RANGE = ["_low", "_high"]


def values_at_ranks(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column],
                    bins: int = BINS, few: int = FEW) -> DataFrame:
    """(group, rank, at, group_rows, value, below, equal): a row per group and rank it has.

    ``ranks`` names 1-based positions in the ascending order of ``value`` (as a double; nulls do
    not count, NaN is the largest), as columns over ``group_rows``; positions outside a group
    have no row. ``below`` and ``equal`` count the rows with a smaller and with the same value.
    Each pass takes a factor of ``bins`` off the span, so two or three do for values of like
    magnitude; more than ``few`` values close together beside ones of 1e300 need up to 200.
    """
    known = _known(df, group, value)
    by = [c for c in known.columns if c != "_v"]
    finite = F.when((F.col("_v") > float("-inf")) & (F.col("_v") < float("inf")), F.col("_v"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("rank"), at.cast("long").alias("at"))
                                 for name, at in ranks.items()]))
    state = materialise(
        known.groupBy(*by).agg(
            F.count(F.lit(1)).alias("group_rows"), F.min("_v").alias("_low"),
            F.max("_v").alias("_high"), F.min(finite).alias("_from"), F.max(finite).alias("_to"))
        .select("*", wanted.alias("_w")).select(
            *by, "_w.rank", "_w.at", "group_rows", *_RANGE, "_from", "_to",
            F.lit(0).cast("long").alias("below"), F.col("group_rows").alias("equal"))
        .filter("at between 1 and group_rows"), "ranks")
    while True:
        several = ~F.col("_low").eqNullSafe(F.col("_high"))
        most = state.filter(several).agg(F.max("equal")).first()[0]
        if most is None:
            break
        step = _gathered if most <= few else _narrowed
        found = step(known, state.filter(several), by, bins)
        state = materialise(state.filter(~several).unionByName(found), "ranks")
    return state.select(*group, "rank", "at", "group_rows", F.col("_low").alias("value"),
                        "below", "equal")


def _known(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Grouping columns and ``_v``; without any, all rows are one group."""
    known = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    return known if group else known.withColumn("_all", _one_group())


def _one_group() -> Column:
    """Always 0, which Catalyst does not see: a join on it stays a hash join."""
    return F.pmod(F.hash("_v"), F.lit(1))


def _inside(known: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the bounds of a range, once for each different range of their group."""
    ranges = state.select(*by, *_RANGE, "_from", "_to").distinct()
    return match(known, ranges, by, "inner").filter("_v between _low and _high")


def _narrowed(known: DataFrame, state: DataFrame, by: list[str], bins: int) -> DataFrame:
    # Halves, as the difference of two doubles need not be one; a span too small to be divided
    # still tells its two ends apart.
    share = F.expr("try_divide(_v / 2 - _from / 2, _to / 2 - _from / 2)")
    spot = F.least(F.lit(bins - 1), F.floor(share * bins))
    bin_of = (F.when(F.isnan("_v"), bins + 1).when(F.col("_v") == float("inf"), bins)
              .when(F.col("_v") == float("-inf"), -1)
              .otherwise(F.coalesce(spot, F.when(F.col("_v") == F.col("_to"), bins - 1)
                                    .otherwise(0))).cast("int"))
    counted = _inside(known, state, by).groupBy(*by, *_RANGE, bin_of.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # At most bins + 3 rows per range.
    before = W.partitionBy(*by, *_RANGE).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    summed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = F.col("at") - F.col("below")
    return match(state, summed, [*by, *_RANGE], "inner").filter(
        (at > F.col("_before")) & (at <= F.col("_before") + F.col("_n"))).select(
        *by, "rank", "at", "group_rows", F.col("_lo").alias("_low"), F.col("_hi").alias("_high"),
        F.col("_lo").alias("_from"), F.col("_hi").alias("_to"),
        (F.col("below") + F.col("_before")).alias("below"), F.col("_n").alias("equal"))


def _gathered(known: DataFrame, state: DataFrame, by: list[str], bins: int) -> DataFrame:
    lists = _inside(known, state, by).groupBy(*by, *_RANGE).agg(
        F.sort_array(F.collect_list("_v")).alias("_vs"))
    found = match(state, lists, [*by, *_RANGE], "inner").withColumn(
        "_x", F.expr("element_at(_vs, cast(at - below as int))"))
    return found.select(
        *by, "rank", "at", "group_rows", F.col("_x").alias("_low"), F.col("_x").alias("_high"),
        F.col("_x").alias("_from"), F.col("_x").alias("_to"),
        (F.col("below") + F.expr("size(filter(_vs, x -> x < _x))")).alias("below"),
        F.expr("cast(size(filter(_vs, x -> x = _x)) as long)").alias("equal"))


def exact_medians(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Exact median of ``value`` per group: mean of the one or two middle rows."""
    n = F.col("group_rows")
    middle = values_at_ranks(df, group, value, {"lower": F.floor((n + 1) / 2),
                                                "upper": F.floor((n + 2) / 2)})
    return middle.groupBy(*group).agg(F.avg("value").alias(name))


def with_ntile(df: DataFrame, group: list[str], value: str, ties: list[str], tiles: int,
               name: str) -> DataFrame:
    """``df`` with SQL's ``ntile(tiles)`` of its rows by ``value``, then ``ties``, per group.

    A row is compared with the values at which tiles begin. Only where rows of one value lie on
    both sides of such a place are these rows put in order, spread over tasks. Rows without a
    value have no tile.
    """
    n = F.col("group_rows")
    starts = {str(t): F.floor(n / tiles) * t + F.least(F.lit(t), n % tiles) + 1
              for t in range(1, tiles)}
    cuts = values_at_ranks(df, group, value, starts)
    by = group or ["_all"]
    keyed = df.withColumn("_v", F.col(value).cast("double"))
    if not group:
        keyed = keyed.withColumn("_all", _one_group())
        cuts = cuts.withColumn("_all", F.pmod(F.hash("value"), F.lit(1)))
    ladder = cuts.groupBy(*by).agg(F.collect_list("value").alias("_cuts"))
    passed = F.expr("cast(1 + size(filter(coalesce(_cuts, array()), x -> x <= _v)) as int)")
    placed = match(keyed, ladder, by, "left").withColumn(
        name, F.when(F.col("_v").isNotNull(), passed)).drop("_cuts")
    split = cuts.filter("at > below + 1")
    if not split.isEmpty():
        torn = split.select(*by, F.col("value").alias("_v"), F.col("below").alias("_below"),
                            F.col("group_rows").alias("_of")).distinct()
        tied = match(placed, torn, [*by, "_v"], "inner").drop(name)
        numbered = number_rows(tied, [*by, "_v"], [F.col(t) for t in ties])
        shifted = numbered.withColumn("row_number", F.col("row_number") + F.col("_below")) \
            .withColumn("group_rows", F.col("_of")).withColumn(name, ntile_of(tiles))
        rest = match(placed, torn.select(*by, "_v"), [*by, "_v"], "left_anti")
        placed = rest.select(*df.columns, name).unionByName(shifted.select(*df.columns, name))
    return placed.select(*df.columns, name)
