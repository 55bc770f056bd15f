"""Data-quality checks. Each returns the violating rows; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


# Columns every mart must fill.
REQUIRED = {
    "pit": ("entity_id", "concept", "period_end", "value", "source_tag",
            "restatement_eligible", "was_restated", "tag_switch_detected"),
    "beneish": ("entity_id", "period_fiscal_year"),
    "altman": ("entity_id", "period_fiscal_year"),
    "piotroski": ("entity_id", "period_fiscal_year"),
    "financials_as_of": ("entity_id", "event_label", "as_of_date"),
    "scores_as_of": ("event_ticker", "period_fiscal_year"),
    "accrual_returns": ("entity_id", "period_fiscal_year"),
    "screener": ("entity_id", "ticker", "period_fiscal_year", "red_flag_count",
                 "models_scored"),
    "concepts": ("concept", "restatement_eligible"),
    "case_studies": ("ticker", "case_study_note"),
    "backtest_events": ("ticker", "as_of_date"),
}


def null_counts(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """(column, n_null) for every listed column, from one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_null")


def null_violations(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    return null_counts(df, columns).filter("n_null > 0")


def required_columns(marts: dict[str, DataFrame]) -> DataFrame:
    """(mart, column, n_null) for the required columns of the given marts."""
    parts = [null_counts(df, REQUIRED[name]).select(F.lit(name).alias("mart"), "column", "n_null")
             for name, df in marts.items()]
    return reduce(DataFrame.union, parts)


def repeated(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside_values(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(*accepted))


def is_implausible(column: str) -> Column:
    low, high = fixed.PLAUSIBLE[column]
    return (F.col(column) < low) | (F.col(column) > high)


def outside_range(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_implausible(column))


NEGATIVE_MAGNITUDE = "sign_convention = 'always_positive' and value < 0"


def negative_magnitudes(staged: DataFrame) -> DataFrame:
    return staged.filter(NEGATIVE_MAGNITUDE)


def repeated_first_reports(pit: DataFrame, ticker: str | None = None,
                           fiscal_year: int | None = None) -> DataFrame:
    """More than one first report for a company, concept and fiscal year; also the check that
    a changed fiscal year end leaves a single canonical period."""
    rows = pit.filter("is_first_report")
    if ticker is not None:
        rows = rows.filter(F.col("ticker") == ticker)
    if fiscal_year is not None:
        rows = rows.filter(F.col("period_fiscal_year") == fiscal_year)
    return repeated(rows, ["entity_id", "concept", "period_fiscal_year"])


def unanchored_instants(pit: DataFrame, staged: DataFrame) -> DataFrame:
    """Balance-sheet rows in the table whose filing reports no full year ending that day."""
    year_ends = staged.filter(F.col("form").isin(*fixed.ANNUAL_FORMS)
                              & (F.col("period_type") == "annual")).select(
        "entity_id", "accession", "period_end").distinct()
    return pit.filter("period_start is null").join(
        year_ends, ["entity_id", "accession", "period_end"], "left_anti")


def rows_on_dates(pit: DataFrame, ticker: str, dates: list[str]) -> DataFrame:
    """Rows of one company on period ends that must not appear."""
    return pit.filter((F.col("ticker") == ticker)
                      & F.col("period_end").isin(*[F.to_date(F.lit(d)) for d in dates]))


def large_lineage_moves(pit: DataFrame, concept: str, ticker: str | None = None,
                        fiscal_year: int | None = None) -> DataFrame:
    """In-lineage values of a concept that moved by more than their own size."""
    rows = pit.filter((F.col("concept") == concept) & F.col("in_lineage")
                      & (F.abs(F.col("restatement_pct")) > 1.0))
    if ticker is not None:
        rows = rows.filter(F.col("ticker") == ticker)
    if fiscal_year is not None:
        rows = rows.filter(F.col("period_fiscal_year") == fiscal_year)
    return rows


def wrong_component_sum(pit: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """First reports of summed concepts that are not a labelled sum near the expected value.

    ``expected`` holds (ticker, concept, period_fiscal_year, expected_value).
    """
    rows = pit.filter("is_first_report").join(
        expected, ["ticker", "concept", "period_fiscal_year"])
    return rows.filter(~F.col("source_tag").like("%+%")
                       | (F.abs(F.col("value") - F.col("expected_value")) > tolerance))


def totals_beside_components(staged: DataFrame) -> DataFrame:
    """Filings where a summed concept may count a total beside its own components."""
    cogs_totals = F.col("source_tag").isin("CostOfGoodsAndServicesSold", "CostOfRevenue")
    return (staged.filter("combine_mode = 'sum' and period_type = 'annual'")
            .groupBy("entity_id", "concept", "period_end", "accession")
            .agg(F.count_if(cogs_totals).alias("totals"),
                 F.count_if(~cogs_totals).alias("components"))
            .filter("totals > 0 and components > 0"))


def priced_foreign_filers(altman: DataFrame, pit: DataFrame) -> DataFrame:
    foreign = pit.filter(F.col("form").isin(*fixed.FOREIGN_FORMS)).select("entity_id").distinct()
    return altman.join(foreign, "entity_id", "left_semi").filter(
        "market_value_of_equity is not null or z_score is not null")


INCONSISTENT_FLAGS = ("not (red_flag_count between 0 and 3) or "
                      "not (models_scored between 0 and 3) or red_flag_count > models_scored")


def inconsistent_flag_counts(screener: DataFrame) -> DataFrame:
    return screener.filter(INCONSISTENT_FLAGS)


def unreconciled(scores: DataFrame, scored: DataFrame) -> DataFrame:
    """Full-history as-of scores that differ from production, missing M and Z read as zero."""
    key = ["ticker", "period_fiscal_year"]
    then = scores.filter("event_label = 'full_history'").select(
        *key, *[F.col(c).alias(f"asof_{c[0]}") for c in ("m_score", "z_score", "f_score")])
    tickers = then.select("ticker").distinct()
    now = scored.join(tickers, "ticker", "left_semi").select(
        *key, *[F.col(c).alias(f"prod_{c[0]}") for c in ("m_score", "z_score", "f_score")])
    zero = F.lit(0.0)
    gaps = [F.abs(F.coalesce(f"asof_{s}", zero) - F.coalesce(f"prod_{s}", zero)) > 0.001
            for s in ("m", "z")]
    none = F.lit(-1)
    gaps.append(F.coalesce("asof_f", none) != F.coalesce("prod_f", none))
    return then.join(now, key, "full").filter(reduce(lambda a, b: a | b, gaps))


def top_years(scored: DataFrame) -> DataFrame:
    """Fiscal year of each company's highest M-score (the later one on a tie)."""
    best = F.max(F.struct("m_score", "period_fiscal_year")).alias("_top")
    return scored.filter("m_score is not null").groupBy("ticker").agg(best).select(
        "ticker", F.col("_top.period_fiscal_year").alias("period_fiscal_year"),
        F.col("_top.m_score").alias("m_score"))


def unexpected_top_year(scored: DataFrame, expected: DataFrame) -> DataFrame:
    """Companies whose highest M-score is not in the year expected of them."""
    asked = expected.select("ticker", F.col("period_fiscal_year").alias("_expected"))
    return top_years(scored).join(asked, "ticker").filter(
        F.col("period_fiscal_year") != F.col("_expected")).drop("_expected")
