"""Beneish, Altman and Piotroski scores from one shared company-year table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators.pricing import fold_prices, with_close
from ..operators.wide import company_years, with_previous_year

INDICES = ("dsri", "gmi", "aqi", "sgi", "depi", "sgai", "tata", "lvgi")
FACTORS = ("x1", "x2", "x3", "x4", "x5")
SIGNALS = ("positive_roa", "positive_cfo", "roa_improved", "earnings_quality",
           "leverage_decreased", "liquidity_improved", "no_dilution", "margin_improved",
           "turnover_improved")
SIGNAL_COLUMNS = tuple(f"signal_{name}" for name in SIGNALS)

_YOY = ("revenue", "gross_profit", "receivables", "current_assets", "total_assets", "ppe_net",
        "depreciation_amortisation", "sga", "current_liabilities", "long_term_debt",
        "total_liabilities", "net_income", "shares", "shares_current_basis")
_IDENTITY = ("entity_id", "ticker", "company_name")


def score_years(years: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("entity_id",),
                share_basis: str = "shares") -> DataFrame:
    """All indices, factors, signals and scores on one row per company-year.

    Market value pairs the latest share count with split-adjusted closes on purpose; it is the
    one figure here that is not point-in-time. ``share_basis`` names the share count compared
    for dilution: ``shares`` (as first filed) or ``shares_current_basis``.
    """
    paired = with_previous_year(years, _YOY, keys)
    priced = with_close(paired, fold_prices(prices), F.col("period_end"), "backward",
                        "price_date", "price_at_period_end")

    valued = priced.withColumn("market_value_of_equity", F.expr(
        "case when not is_foreign_filer then price_at_period_end * shares_current_basis end"))
    signals = {f"signal_{n}": test for n, test in S.piotroski_signals(share_basis).items()}
    parts = valued.selectExpr("*", *_named(S.beneish_indices()), *_named(S.altman_factors()),
                              *_named(signals))
    sums = parts.selectExpr("*", f"{S.altman_sum()} as _z",
                            f"{' + '.join(SIGNAL_COLUMNS)} as f_score")
    return sums.selectExpr("*", *_named({
        "m_missing_inputs": S.missing(INDICES),
        "m_score": S.m_score(),
        "z_missing_inputs": S.missing(FACTORS),
        "z_score": "round(_z, 3)",
        "zone": S.altman_zone("_z"),
        "missing_signals": S.missing(SIGNALS, "signal_"),
        "band": S.piotroski_band("f_score"),
    })).drop("previous", "_z")


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{made} as {name}" for name, made in columns.items()]


def scored_company_years(pit: DataFrame, prices: DataFrame) -> DataFrame:
    return score_years(company_years(pit), prices)


def beneish(scored: DataFrame) -> DataFrame:
    return scored.select(*_IDENTITY, "period_fiscal_year", *INDICES,
                         F.col("m_missing_inputs").alias("missing_inputs"), "m_score")


def altman(scored: DataFrame) -> DataFrame:
    return scored.select(*_IDENTITY, "period_end", "period_fiscal_year", "price_date",
                         "price_at_period_end", "market_value_of_equity", *FACTORS,
                         F.col("z_missing_inputs").alias("missing_inputs"), "z_score", "zone")


def piotroski(scored: DataFrame) -> DataFrame:
    return scored.select(*_IDENTITY, "period_end", "period_fiscal_year", *SIGNAL_COLUMNS,
                         "missing_signals", "f_score", "band")


def score_detail(scored: DataFrame) -> DataFrame:
    """The 22 components behind the scores, with the drill-through key."""
    return scored.select(
        *_IDENTITY, "period_fiscal_year",
        F.concat_ws("-", "entity_id", "period_fiscal_year").alias("detail_key"),
        *INDICES, *FACTORS, *SIGNAL_COLUMNS)
