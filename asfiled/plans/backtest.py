"""What the screen would have shown on a past date.

``visible_years`` and ``strict_pit`` answer at two depths. The first keeps the lineage, canonical
period and latest share count of the full history and hides only the fiscal years not yet filed.
The second shows what a table built on that date would have held, so nothing filed later can leak
in: ``strict_years`` reads it off the knowledge intervals, ``strict_pit`` is the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from ..operators.bitemporal import financials_pit
from ..operators.knowledge import knowledge_intervals, known_on, unsettled_companies
from ..operators.volume import ROW_LIMIT, dealt, match
from ..operators.wide import company_years, foreign_marks
from .scoring import score_years

EVENT_KEYS = ("event_ticker", "event_label", "as_of_date", "public_event_date",
              "event_description")
_WORLD = (*EVENT_KEYS, "entity_id")
_SHORT_WORLD = ("_event", "entity_id")


def _events(events: DataFrame) -> DataFrame:
    """Events, each once, with a short number that stands for them until the years are made."""
    named = events.select(F.col("ticker").alias("event_ticker"), *EVENT_KEYS[1:]).distinct()
    return named.withColumn("_event", F.xxhash64(*EVENT_KEYS))


def _short(named: DataFrame) -> DataFrame:
    return named.select("_event", "event_ticker", "as_of_date")


def _told(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The event columns in place of the event's number."""
    kept = [c for c in rows.columns if c != "_event"]
    return rows.join(named, "_event").select(*EVENT_KEYS, *kept)


def visible_years(pit: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (event, company, fiscal year) whose figures were public by the as-of date.

    The join is an equi-join on ticker; no hint, so Spark broadcasts the events only when their
    measured size allows it. First reports are picked at the scan and dates compared in the join,
    so only what is visible is shuffled, under the event's number.
    """
    named = _events(events)
    first, short = pit.filter("is_first_report"), _short(named)
    rows = first.join(short, (first["ticker"] == short["event_ticker"])
                      & (first["first_filed_date"] <= short["as_of_date"]))
    years = company_years(rows, _SHORT_WORLD, foreign=foreign_marks(pit))
    return _told(years, named)


def strict_pit(staged: DataFrame, events: DataFrame, row_limit: int = ROW_LIMIT,
               counted: DataFrame | None = None) -> DataFrame:
    """The bitemporal table rebuilt for every event from facts filed by its as-of date."""
    named = _events(events)
    return _told(_strict(staged, named, row_limit, counted), named)


def _strict(staged: DataFrame, named: DataFrame, row_limit: int,
            counted: DataFrame | None) -> DataFrame:
    short = _short(named)
    known = staged.join(short, (staged["ticker"] == short["event_ticker"])
                        & (staged["filed_date"] <= short["as_of_date"]))
    return financials_pit(known, _SHORT_WORLD, row_limit, staged if counted is None else counted)


def strict_years(staged: DataFrame, events: DataFrame, row_limit: int = ROW_LIMIT,
                 counted: DataFrame | None = None, intervals: DataFrame | None = None,
                 unsettled: DataFrame | None = None) -> DataFrame:
    """One row per (event, company, fiscal year) as a rebuild from the facts filed by the as-of
    date would give it.

    ``intervals`` and ``unsettled`` are the knowledge intervals and unsettled companies of
    ``staged``, written tables as a rule and worked out here where they are not given. They answer
    any number of events; only unsettled companies are rebuilt event by event. The canonical
    period is settled among the figures of the event, in the partitioning that the pivot uses
    anyhow.
    """
    named = _events(events)
    rebuilt = unsettled
    if rebuilt is None:
        rebuilt = materialise(unsettled_companies(staged, row_limit), "unsettled")
    if intervals is None:
        intervals = knowledge_intervals(financials_pit(staged, row_limit=row_limit, counted=counted))
    settled = match(intervals, rebuilt, ["entity_id"], "left_anti")
    years = _years_known(settled, _short(named))
    if not rebuilt.isEmpty():
        again = match(staged, rebuilt, ["entity_id"], "left_semi")
        years = years.unionByName(company_years(
            _strict(again, named, row_limit, None), _SHORT_WORLD))
    return _told(years, named)


def _years_known(intervals: DataFrame, short: DataFrame) -> DataFrame:
    known = intervals.join(short, (intervals["ticker"] == short["event_ticker"])
                           & known_on(intervals, short["as_of_date"]))
    year = f"partition by {', '.join(_SHORT_WORLD)}, period_fiscal_year"
    rows = dealt(known.drop("event_ticker", "as_of_date"), [*_SHORT_WORLD], known.count())
    supported = rows.selectExpr(
        "*", f"count_if(is_supported) over ({year}, period_end) as _support",
    ).selectExpr("*", f"max(struct(_support, period_end)) over ({year}) as _top")
    first = F.col("is_supported") & (F.col("period_end") == F.col("_top.period_end"))
    return company_years(supported, _SHORT_WORLD, visible=first, abroad=F.col("is_foreign"))


def panel(years: DataFrame) -> DataFrame:
    """The as-of financials: event columns, reported and derived figures."""
    return years.select(
        *EVENT_KEYS, "entity_id", "ticker", "company_name", "form", "period_end",
        "period_fiscal_year", "revenue", "cogs", "gross_profit_reported", "receivables",
        "current_assets", "total_assets", "ppe_net", "depreciation_amortisation", "sga",
        "current_liabilities", "long_term_debt", "total_liabilities_reported", "net_income",
        "cfo", "retained_earnings", "operating_income", "shares_current_basis",
        "gross_profit", "total_liabilities")


def scores_as_of(years: DataFrame, prices: DataFrame, share_basis: str = "shares") -> DataFrame:
    """Scores per event, by the very functions that make the production scores."""
    return score_years(years, prices, _WORLD, share_basis).select(
        *EVENT_KEYS[:4], "ticker", "company_name", "period_fiscal_year",
        "m_score", "z_score", "f_score")
