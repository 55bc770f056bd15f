"""Row numbers and n-tiles without a one-task window.

A window partitioned by fiscal year, by quintile or by nothing at all would sort an unbounded
group in one task. Here rows are range-partitioned on (group, order), so a large group spans
many tasks; each task numbers its slice, and only one row per (slice, group) is needed to turn
the local numbers into global ones. The numbered rows are written once, because range bounds are
sampled and must not be drawn twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..durable import materialise
from .volume import match

_SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def number_rows(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Add ``row_number`` (1-based within ``group``) and ``group_rows``.

    ``order`` should be a total order within the group: its tie-breakers are also what spreads
    a group whose leading order value is shared by very many rows.
    """
    ordering = [*(F.col(g) for g in group), *order]
    spread = (df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
              .withColumn("_slot", F.monotonically_increasing_id()))
    placed = (materialise(spread, "numbered")
              .withColumn("_slice", F.shiftright("_slot", _SLICE_BITS)))

    # One row per (slice, group): at most one per task for a group, whatever the group's size.
    slices = placed.groupBy("_slice", *group).agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    within = W.partitionBy(*group)
    earlier = within.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select(
        "_slice", *group, "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(within).alias("group_rows"))

    return match(placed, offsets, ["_slice", *group], "inner").select(
        *df.columns, (F.col("_slot") - F.col("_first") + F.col("_before") + 1)
        .alias("row_number"), "group_rows")


def ntile_of(tiles: int) -> Column:
    """SQL ``ntile`` from ``row_number`` and ``group_rows``: larger tiles come first."""
    n, at = F.col("group_rows"), F.col("row_number") - 1
    size, longer = F.floor(n / tiles), n % tiles
    head = longer * (size + 1)
    in_head = F.floor(at / (size + 1))
    in_tail = longer + F.floor((at - head) / F.greatest(size, F.lit(1)))
    return (F.when(at < head, in_head).otherwise(in_tail) + 1).cast("int")
