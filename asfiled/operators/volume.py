"""Deciding from row counts, never from hope, which plan a key gets.

Most work here is keyed by company. A company whose rows fit comfortably in one task lets every
later window, aggregate and pivot reuse a single exchange on the company key. A company that
holds, say, a third of all rows must not do that. ``heavy_keys`` counts rows per key (one pruned
column, combined on the map side) and returns the keys above the bound, or ``None``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import materialise

# Rows of one company that a single task may hold (a few hundred MB of facts).
ROW_LIMIT = 2_000_000
# Rows that a task is dealt, on average, where all rows of a company must meet.
TASK_ROWS = 500_000


def heavy_keys(df: DataFrame, keys: list[str], row_limit: int = ROW_LIMIT) -> DataFrame | None:
    """Keys with more than ``row_limit`` rows; at most ``rows / row_limit`` of them exist."""
    heavy = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
             .filter(F.col("_rows") > row_limit).select(*keys))
    return None if heavy.isEmpty() else materialise(heavy, "heavy_keys")


def tasks_for(rows: int, spark: SparkSession) -> int:
    """How many tasks ``rows`` are dealt to, so that a task's share does not grow with the input.

    Merging shuffle partitions by their size would not do: rows of facts shrink some fifty times
    when they are shuffled, so that a partition of ordinary size fills a task's memory.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, exchanged once on ``keys`` over tasks of bounded size."""
    return df.repartition(tasks_for(rows, df.sparkSession), *keys)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on null-safe equality of ``keys`` (a hash-joinable condition); keys appear once."""
    twins = {k: f"_same_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(t)) for k, t in twins.items()))
    return left.join(right.withColumnsRenamed(twins), on, how).drop(*twins.values())


def part_by_volume(df: DataFrame, heavy: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of heavy keys); together they are exactly ``df``."""
    return match(df, heavy, keys, "left_anti"), match(df, heavy, keys, "left_semi")
