"""Long to wide: one row per company and fiscal year, shared by all three scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed

# Concepts any score reads; ``shares`` is the count as first filed.
CONCEPTS = (
    "revenue", "cogs", "gross_profit", "receivables", "current_assets", "total_assets",
    "ppe_net", "depreciation_amortisation", "sga", "current_liabilities", "long_term_debt",
    "total_liabilities", "net_income", "cfo", "retained_earnings", "operating_income",
)
# Concepts with a second derivation when a filer does not report them.
_DERIVABLE = ("gross_profit", "total_liabilities")
# Concepts whose filing makes the accrual of a year computable.
ACCRUAL_CONCEPTS = ("net_income", "cfo", "total_assets")


def company_years(pit: DataFrame, keys: tuple[str, ...] = ("entity_id",),
                  visible: Column | None = None, foreign: DataFrame | None = None,
                  abroad: Column | None = None) -> DataFrame:
    """Pivot the bitemporal table to one row per ``keys`` and fiscal year.

    Only visible first reports feed the figures. Whether a company files foreign forms is a
    property of all its rows, so the pivot runs over all of them and keeps the years that have
    a visible first report; that costs no second scan and no join. After the pivot a company has
    one row per period end, so the window that spreads the foreign mark is bounded by days.

    A caller that has left rows out before hands in ``foreign``, the result of
    :func:`foreign_marks` over all of them, or ``abroad``, whether a row knows of a foreign form.
    """
    keys = list(keys)
    seen = F.col("is_first_report") if visible is None else visible
    rows = pit.withColumn("_seen", F.coalesce(seen, F.lit(False))).withColumn(
        "_abroad", F.col("form").isin(*fixed.FOREIGN_FORMS) if abroad is None else abroad)

    def figure(concept: str, name: str, column: str = "value") -> str:
        return f"max(if(_seen and concept = '{concept}', {column}, null)) as {name}"

    known = ", ".join(f"'{c}'" for c in ACCRUAL_CONCEPTS)
    pivoted = rows.groupBy(*keys, "period_end", "period_fiscal_year").agg(*map(F.expr, [
        *[f"max(if(_seen, {label}, null)) as {label}"
          for label in ("ticker", "company_name", "form")],
        *[figure(c, f"{c}_reported" if c in _DERIVABLE else c) for c in CONCEPTS],
        figure("shares_diluted", "shares"),
        figure("shares_diluted", "shares_current_basis", "latest_reported_value"),
        f"max(if(_seen and concept in ({known}), first_filed_date, null)) as accrual_known_date",
        "max(_abroad) as _foreign", "max(_seen) as _kept"]))

    if foreign is None:
        whole = pivoted.withColumn("is_foreign_filer", F.expr(
            f"max(_foreign) over (partition by {', '.join(keys)})"))
    else:
        whole = pivoted.join(foreign, "entity_id").select(*pivoted.columns, "is_foreign_filer")
    return whole.filter("_kept").drop("_foreign", "_kept").selectExpr(
        "*", "coalesce(gross_profit_reported, revenue - cogs) as gross_profit",
        "coalesce(total_liabilities_reported, current_liabilities + long_term_debt) "
        "as total_liabilities")


def foreign_marks(pit: DataFrame) -> DataFrame:
    """(entity_id, is_foreign_filer): whether any row of the company has a foreign form."""
    return pit.groupBy("entity_id").agg(
        F.max(F.col("form").isin(*fixed.FOREIGN_FORMS)).alias("is_foreign_filer"))


def with_previous_year(years: DataFrame, columns: tuple[str, ...],
                       keys: tuple[str, ...] = ("entity_id",),
                       name: str = "previous") -> DataFrame:
    """Add a struct of ``columns`` from fiscal year − 1, null where that year is absent.

    ``years`` holds one row per key and fiscal year, so a partition of the window is bounded by
    the number of fiscal years. The guard on the year is what a plain ``lag`` would lack.
    """
    timeline = W.partitionBy(*keys).orderBy("period_fiscal_year")
    adjacent = F.lag("period_fiscal_year").over(timeline) == F.col("period_fiscal_year") - 1
    return years.withColumn(
        name, F.when(adjacent, F.lag(F.struct(*columns)).over(timeline)))
