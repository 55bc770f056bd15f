"""Which companies to ingest.

A list has an order, which ``position`` carries: file, place of the read block in the file, row in
the block. It is a struct that sorts, so that it is the list's order whatever the number of files,
splits and tasks. :func:`ranked` turns it into numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..operators.ranking import number_rows

_CASES = tuple(ticker for ticker, _ in fixed.CASE_STUDIES)
LISTS = {"baseline": fixed.BASELINE_TICKERS, "cases": _CASES,
         "pilot": fixed.BASELINE_TICKERS + _CASES}


def named_universe(spark: SparkSession, name: str, folder: str | None = None,
                   index: str = "sp500") -> DataFrame:
    """(position, ticker) of a named list, of ``<folder>/<name>.csv``, or of ``full``: the
    constituents in ``<folder>/<index>.csv`` and the case studies."""
    if name in LISTS:
        return _listed(spark, LISTS[name])
    if folder is None:
        raise ValueError(f"unknown universe {name!r}; give the folder of its CSV file")
    if name == "full":
        return union_universe(_from_csv(spark, f"{folder}/{index}.csv"), _listed(spark, _CASES))
    return _from_csv(spark, f"{folder}/{name}.csv")


def _listed(spark: SparkSession, tickers: tuple[str, ...]) -> DataFrame:
    rows = spark.createDataFrame(pa.table({
        "row": pa.array(range(len(tickers)), pa.int64()), "ticker": list(tickers)}))
    return rows.select(_position(F.lit(""), F.lit(0), F.col("row")), "ticker")


def _position(file: Column, block: Column, row: Column) -> Column:
    return F.struct(file.alias("file"), block.cast("long").alias("block"),
                    row.alias("row")).alias("position")


def _from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a CSV file or of a folder of them, which are read in the order of their names.

    Spark deals out the blocks of files by size, so a running number over its tasks is no order
    of the list. Within a block rows are numbered as they are read.
    """
    rows = spark.read.csv(path, header=True)
    return rows.select(
        _position(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                  F.monotonically_increasing_id()),
        F.upper(F.trim("ticker")).alias("ticker")).filter("ticker != ''")


def union_universe(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists without repeats, the first one's before the second one's: (_list, position,
    ticker), ordered by the first two. A ticker keeps its first place."""
    both = (first.select(F.lit(0).alias("_list"), "position", "ticker")
            .union(second.select(F.lit(1), "position", "ticker")))
    kept = both.groupBy("ticker").agg(F.min(F.struct("_list", "position")).alias("_at"))
    return kept.select("_at._list", "_at.position", "ticker")


def ranked(listed: DataFrame) -> DataFrame:
    """(rank, ticker) of a list or union of lists, without repeats, from 1; no task sorts it all."""
    order = [c for c in ("_list", "position") if c in listed.columns]
    first = listed.groupBy("ticker").agg(F.min(F.struct(*order)).alias("_at")).select(
        F.lit(0).alias("_all"), "_at", "ticker")
    return number_rows(first, ["_all"], [F.col("_at")]).select(
        F.col("row_number").alias("rank"), "ticker")


def select_companies(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    """Requested companies, one row per entity after matching, so every ticker can match.

    Of an entity's requested tickers the one that stands first in the company map stays.
    """
    asked = companies.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    first = asked.groupBy("entity_id").agg(
        F.min(F.struct("position", "ticker", "company_name")).alias("_c"))
    return first.select("entity_id", "_c.ticker", "_c.company_name", "_c.position")


def missing_tickers(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    """Requested tickers the selection does not hold."""
    return tickers.select("ticker").distinct().join(
        select_companies(companies, tickers), "ticker", "left_anti")
