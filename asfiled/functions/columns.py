"""Small column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; null when either is null or the divisor is zero."""
    return F.try_divide(top, bottom)


def fiscal_year_of(period_end: Column) -> Column:
    """Fiscal year of a period: a year end in the first days of January closes the year before."""
    spilled = (F.month(period_end) == 1) & (F.dayofmonth(period_end) <= fixed.JANUARY_SPILL_DAYS)
    return F.year(period_end) - F.when(spilled, 1).otherwise(0)


def period_length(period_start: Column, period_end: Column) -> Column:
    return F.datediff(period_end, period_start)


def filing_lag(period_end: Column, filed_date: Column) -> Column:
    return F.datediff(filed_date, period_end)


def period_class(days: Column) -> Column:
    """Name of a period by its length in days; no length means a balance-sheet instant."""
    named = F.when(days.isNull(), "instant")
    for name, shortest, longest in fixed.PERIOD_CLASSES:
        named = named.when(days.between(shortest, longest), name)
    return named.otherwise("other")
