"""Accruals against later returns: panel, quintiles and the portfolio-sort test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..durable import materialise
from ..functions import ratio
from ..functions.stats import normal_two_sided_p
from ..operators.pricing import fold_prices, with_close
from ..operators.selection import exact_medians, with_ntile

_PANEL = ("entity_id", "ticker", "period_fiscal_year", "tata", "first_filed_date",
          "entry_date", "entry_price", "exit_date", "exit_price", "fwd_return_12m")


def forward_returns(scored: DataFrame, prices: DataFrame) -> DataFrame:
    """12-month return of every company-year with an accrual, entered when it became known.

    The entry day is the latest first filing among the figures the accrual needs, so there is
    exactly one row per company-year and no position starts before its signal.
    """
    base = scored.filter(F.col("tata").isNotNull()).select(
        "entity_id", "ticker", "period_fiscal_year", "tata",
        F.col("accrual_known_date").alias("first_filed_date"))
    folded = fold_prices(prices)
    entry = with_close(base, folded, F.col("first_filed_date"), "forward",
                       "entry_date", "entry_price")
    both = with_close(entry, folded, F.date_add("first_filed_date", fixed.HOLDING_DAYS),
                      "forward", "exit_date", "exit_price")
    grown = F.round(ratio(F.col("exit_price"), F.col("entry_price")) - 1, 4)
    return both.withColumn("fwd_return_12m", grown).select(*_PANEL)


def with_quintiles(returns: DataFrame) -> DataFrame:
    """Accrual quintile within each fiscal year, among rows that have a return.

    ``returns`` is read several times, mostly two columns of it, and should be a written table.
    """
    ranked = with_ntile(returns.filter("fwd_return_12m is not null"), ["period_fiscal_year"],
                        "tata", ["entity_id"], 5, "accrual_quintile")
    unranked = returns.filter("fwd_return_12m is null").withColumn(
        "accrual_quintile", F.lit(None).cast("int"))
    return ranked.unionByName(unranked).select(*_PANEL, "accrual_quintile")


def accrual_returns(scored: DataFrame, prices: DataFrame) -> DataFrame:
    return with_quintiles(materialise(forward_returns(scored, prices), "forward_returns"))


def quintile_stats(panel: DataFrame) -> DataFrame:
    sorted_in = panel.filter(F.col("accrual_quintile").isNotNull())
    stats = sorted_in.groupBy("accrual_quintile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("tata").alias("mean_tata"),
        F.avg("fwd_return_12m").alias("mean_return"),
        F.stddev_samp("fwd_return_12m").alias("std_return"))
    medians = exact_medians(sorted_in, ["accrual_quintile"], "fwd_return_12m", "median_return")
    return stats.join(medians, "accrual_quintile", "left").select(
        "accrual_quintile", "n", "mean_tata", "mean_return", "median_return", "std_return")


def hedge_test(stats: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: lowest minus highest quintile, Welch t, two-sided p, number of fiscal years."""
    ends = stats.agg(
        *[F.max_by(c, F.col("accrual_quintile")).alias(f"{c}_top")
          for c in ("n", "mean_return", "median_return", "std_return")],
        *[F.max(F.when(F.col("accrual_quintile") == 1, F.col(c))).alias(f"{c}_low")
          for c in ("n", "mean_return", "median_return", "std_return")])
    years = panel.filter("accrual_quintile is not null").agg(
        F.countDistinct("period_fiscal_year").alias("n_years"))
    spread = F.sqrt(F.pow("std_return_low", F.lit(2)) / F.col("n_low")
                    + F.pow("std_return_top", F.lit(2)) / F.col("n_top"))
    return ends.select(
        (F.col("mean_return_low") - F.col("mean_return_top")).alias("hedge_return"),
        (F.col("median_return_low") - F.col("median_return_top")).alias("median_hedge_return"),
        spread.alias("_spread"),
    ).select(
        "hedge_return", "median_hedge_return",
        F.when(F.col("_spread") > 0, F.col("hedge_return") / F.col("_spread"))
        .otherwise(F.lit(float("nan"))).alias("t_stat"),
        years.scalar().alias("n_years"),
    ).withColumn("p_value", normal_two_sided_p("t_stat"))


def report_lines(stats: DataFrame, test: DataFrame) -> DataFrame:
    """The printed report as rows (line_no, line)."""
    heading = test.select(
        F.lit(1).alias("line_no"),
        F.format_string("Accruals and later returns: %d fiscal years, quintiles by TATA",
                        "n_years").alias("line"))
    titles = test.select(
        F.lit(2), F.lit(" Q       n   mean TATA   mean return   median return       std"))
    body = stats.select(
        (F.col("accrual_quintile") + 2).alias("line_no"),
        F.format_string("%2d  %6d  %10.4f  %11.4f%%  %13.4f%%  %8.4f", "accrual_quintile", "n",
                        "mean_tata", F.col("mean_return") * 100, F.col("median_return") * 100,
                        "std_return"))
    means = test.select(
        F.lit(8), F.format_string("Hedge return, means: %.4f%%  Welch t=%.3f  p=%.4f",
                                  F.col("hedge_return") * 100, "t_stat", "p_value"))
    medians = test.select(
        F.lit(9), F.format_string("Hedge return, medians: %.4f%%",
                                  F.col("median_hedge_return") * 100))
    return heading.union(titles).union(body).union(means).union(medians)
