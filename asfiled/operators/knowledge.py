"""What was known of every figure, and from when to when.

The bitemporal table says what each filing reported. Read forward in filing order it also says, for
every (company, concept, period end), how the figure stood between two filings: which tag was the
latest, which report was the first one of that tag and which the newest. ``knowledge_intervals``
makes that sweep once; the state on any past date is then a filter on its half-open intervals,
whatever the number of dates asked for.

The sweep relies on a filing being known as a whole on its filing date. ``unsettled_companies``
names the companies of which that cannot be said; they need a rebuild from facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .volume import ROW_LIMIT, dealt

#: Columns of the first report that a state carries.
_FIRST = ("ticker", "company_name", "form", "value", "filed_date")


def knowledge_intervals(pit: DataFrame) -> DataFrame:
    """(entity_id, concept, period_end, known_from, known_to, state) from the bitemporal table.

    A row holds from ``known_from`` until the day before ``known_to`` (null: to this day) and has

    * ``period_fiscal_year``, ``latest_tag``, ``n_distinct_tags`` and ``n_reports`` by then,
    * of the first report in the lineage of that tag: ``value``, ``ticker``, ``company_name``,
      ``form``, ``first_filed_date``; and ``latest_reported_value``,
    * ``is_supported``: whether that first report can stand for a period, having an accession,
    * ``is_foreign``: whether any report so far came on a foreign form.

    All windows share one exchange on the company and the order of filing dates within a figure;
    they run forward only. Reports of one day are known together.
    """
    figure = "entity_id, period_fiscal_year, period_end, concept"
    upto = f"(partition by {figure} order by filed_date)"  # with the day's other reports
    tag = f"{figure}, source_tag"
    abroad = ", ".join(f"'{f}'" for f in fixed.FOREIGN_FORMS)
    age = "struct(filed_date, accession is null as unnumbered, accession)"
    told = ", ".join(_FIRST)
    told_rows = pit.select("entity_id", "period_fiscal_year", "period_end", "concept",
                           "source_tag", "accession", *_FIRST)
    traced = (dealt(told_rows, ["entity_id"], pit.count()).selectExpr(
        "*", f"min(struct({age} as age, {told})) over (partition by {tag}) as _first",
        f"max(struct({age} as age, value)) over (partition by {tag} order by filed_date).value "
        "as _newest",
        f"count(1) over (partition by {tag} order by filed_date) as _reports"))
    # The newest report names the lineage; it brings along that tag's first and latest figures.
    newest = ("struct(filed_date, accession is not null as numbered, accession, source_tag, "
              "_first, _newest, _reports)")
    states = traced.selectExpr(
        *figure.split(", "), "filed_date", f"max({newest}) over {upto} as _now",
        f"cast(size(collect_set(source_tag) over {upto}) as bigint) as n_distinct_tags",
        f"max(form in ({abroad})) over {upto} as is_foreign",
    ).groupBy(*figure.split(", "), "filed_date").agg(
        F.max("_now").alias("_now"), F.max("n_distinct_tags").alias("n_distinct_tags"),
        F.max("is_foreign").alias("is_foreign"))
    return states.selectExpr(
        "entity_id", "concept", "period_end", "filed_date as known_from",
        f"lead(filed_date) over (partition by {figure} order by filed_date) as known_to",
        "period_fiscal_year", "_now.source_tag as latest_tag", "n_distinct_tags",
        "_now._reports as n_reports", "_now._first.ticker", "_now._first.company_name",
        "_now._first.form", "_now._first.value", "_now._first.filed_date as first_filed_date",
        "_now._newest as latest_reported_value",
        "not _now._first.age.unnumbered as is_supported", "is_foreign")


def known_on(intervals: DataFrame, day: Column) -> Column:
    """Whether an interval holds on ``day``."""
    return (intervals["known_from"] <= day) & (intervals["known_to"].isNull()
                                               | (day < intervals["known_to"]))


def unsettled_companies(staged: DataFrame, row_limit: int = ROW_LIMIT) -> DataFrame:
    """Companies whose figures may have become known in parts, or that do not fit one task.

    That is: an accession with several filing dates, more than one ticker or none, or more than
    ``row_limit`` rows; and facts without accession beside others of the same figure, or under a
    form that only some of the company's filings have. (A figure told without accession only never
    stands for a period, whenever it was told.) One narrow row per filing is shuffled, and the
    figures that have a fact without accession.
    """
    annual = staged.filter(F.col("form").isin(*fixed.ANNUAL_FORMS)
                           & F.col("period_type").isin("annual", "instant"))
    filings = annual.groupBy("entity_id", "accession").agg(
        F.min("filed_date").alias("_from"), F.max("filed_date").alias("_to"),
        F.min("ticker").alias("_low"), F.max("ticker").alias("_high"),
        F.max(F.col("ticker").isNull()).alias("_nameless"),
        F.max(F.col("form").isin(*fixed.FOREIGN_FORMS)).alias("_abroad"),
        F.min(F.col("form").isin(*fixed.FOREIGN_FORMS)).alias("_all_abroad"),
        F.count(F.lit(1)).alias("_rows"))
    companies = filings.groupBy("entity_id").agg(
        F.max(F.col("accession").isNotNull() & (F.col("_from") != F.col("_to"))
              | F.col("_nameless")).alias("_parts"),
        F.max(F.col("accession").isNull()).alias("_unnumbered"),
        (F.max("_abroad") != F.min("_all_abroad")).alias("_both"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_rows").alias("_rows"))
    figure = ["entity_id", "concept", "period_end"]
    bare = annual.filter("accession is null").select(*figure).distinct()
    mixed = annual.filter("accession is not null").join(bare, figure, "left_semi")
    return (companies.filter(f"_parts or _low <> _high or _rows > {int(row_limit)} "
                             "or (_unnumbered and _both)").select("entity_id")
            .union(mixed.select("entity_id")).distinct())
