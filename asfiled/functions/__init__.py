from .columns import filing_lag, fiscal_year_of, period_class, period_length, ratio

__all__ = ["filing_lag", "fiscal_year_of", "period_class", "period_length", "ratio"]
