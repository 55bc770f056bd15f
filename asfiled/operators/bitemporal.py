"""The bitemporal fact table: one row per (company, concept, period end, filing).

Valid time is ``period_end``; knowledge time is ``filed_date``. Each row carries the lineage of
the tag that reported it and the restatement measures within that lineage.

Two plans give the same rows:

* *together* -- companies below the row bound of :mod:`.volume`. Facts are exchanged once, on the
  company key; anchoring, de-duplication, lineage, canonical periods and any later pivot or
  year-over-year step are then local to a task.
* *apart* -- companies above the bound. The same steps as map-side combined aggregates and
  equi-joins on fine keys (which AQE splits when skewed), with report versions numbered over
  range slices. No step gathers a company, a period or a group of copies in one task.

Component amounts are added up as decimals (:mod:`..functions.exact`), so a sum does not depend on
the plan, on the number of partitions or on the order in which its parts are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.exact import exact_sum
from .ranking import number_rows
from .volume import ROW_LIMIT, dealt, heavy_keys, match, part_by_volume

PIT_COLUMNS = (
    "entity_id", "ticker", "company_name", "concept", "source_tag", "period_start",
    "period_end", "period_fiscal_year", "filed_date", "filing_lag_days", "form", "accession",
    "value", "restatement_eligible", "sign_was_negative", "latest_tag", "n_distinct_tags",
    "in_lineage", "tag_switch_detected", "report_version", "n_reports",
    "first_reported_value", "latest_reported_value", "first_filed_date", "latest_filed_date",
    "is_first_report", "is_latest_report", "restatement_pct", "was_restated",
)


def financials_pit(staged: DataFrame, keys: tuple[str, ...] = ("entity_id",),
                   row_limit: int = ROW_LIMIT, counted: DataFrame | None = None) -> DataFrame:
    """Build the bitemporal table from staged facts.

    ``keys`` is the company key, optionally preceded by columns that make separate worlds (a
    backtest event, for instance). Rows are counted per company on ``counted``, by default the
    staged facts themselves; any table with at least those rows of a company will do, such as the
    fact table, of which the count then scans one column.
    """
    keys, company = list(keys), ["entity_id"]
    table = staged if counted is None else counted
    heavy = heavy_keys(table, company, row_limit)
    # Separate worlds repeat a company's rows, so there the rows themselves are counted.
    n = (table if keys == company else staged).count()
    if heavy is None:
        return _together(staged, keys, n)
    light_rows, heavy_rows = part_by_volume(staged, heavy, company)
    return _together(light_rows, keys, n).unionByName(_apart(heavy_rows, keys))


def _together(staged: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One exchange on the company, then two sorts whose prefixes serve every window."""
    rows = dealt(staged.filter(_annual_or_instant()), keys, n)
    traced = _canonical_together(_trace_together(_pick_together(rows, keys), keys), keys)
    return _finish(traced.select("*", "_rest.*").drop("_rest"), keys)


def _apart(staged: DataFrame, keys: list[str]) -> DataFrame:
    anchored = anchor_to_annual(staged.filter(_annual_or_instant()), keys)
    traced = _trace_apart(one_value_per_filing(anchored, keys), keys)
    return _finish(_canonical_apart(traced, keys), keys)


# -- anchoring -------------------------------------------------------------------------------

def _annual_or_instant() -> Column:
    return (F.col("form").isin(*fixed.ANNUAL_FORMS)
            & F.col("period_type").isin("annual", "instant"))


def anchor_to_annual(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keep annual rows, and instants whose filing also reports a full year ending that day."""
    rows = rows.filter(_annual_or_instant())
    year_ends = rows.filter("period_type = 'annual' and accession is not null").select(
        *keys, "accession", "period_end").distinct()
    instants = rows.filter("period_type = 'instant'")
    on = [*keys, "accession", "period_end"]
    return rows.filter("period_type = 'annual'").unionByName(
        match(instants, year_ends, on, "left_semi"))


# -- one value per filing --------------------------------------------------------------------

# What a filing's value is told with. An alternative tells it with the columns of the row it picks;
# a sum with the largest entry of each column over its parts, whatever their order.
_TOLD = ("ticker", "company_name", "period_start", "period_fiscal_year", "filed_date",
         "filing_lag_days", "form", "restatement_eligible")


def _most(column: str, at: str) -> str:
    return f"{'bool_and' if column == 'restatement_eligible' else 'max'}({at})"


def one_value_per_filing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Reduce alternative tags to the best one and component tags to their sum.

    First exact repeats collapse (on the map side too), so that what remains per filing is
    bounded by its tags, units and period starts. Then one aggregate serves both modes: the
    smallest (priority, largest value) row, and the sum over all rows.
    """
    filing = [*keys, "concept", "period_end", "accession"]
    described = ["ticker", "company_name", "source_tag", "tag_priority", "unit", "period_start",
                 "period_fiscal_year", "filed_date", "filing_lag_days", "form",
                 "restatement_eligible", "combine_mode"]
    # Alternatives keep the sign mark of the row they pick; components share one mark.
    sign_lane = F.when(F.col("combine_mode") != "sum", F.col("sign_was_negative"))
    distinct = (rows.filter(F.col("unit").isin(*fixed.UNITS))
                .groupBy(*filing, *described, sign_lane.alias("_lane"))
                .agg(F.max("value").alias("value"),
                     F.max("sign_was_negative").alias("sign_was_negative")))

    best = F.min(F.struct(
        "tag_priority", (-F.col("value")).alias("_down"),
        F.col("period_start").isNull().alias("_undated"), "period_start", "unit", "source_tag",
        "filed_date", "form", "ticker", "company_name", "sign_was_negative",
        "period_fiscal_year", "filing_lag_days", "restatement_eligible", "combine_mode",
        "value"))
    merged = distinct.groupBy(*filing).agg(
        best.alias("_best"),
        F.expr(exact_sum("if(combine_mode = 'sum', value, null)")).alias("_total"),
        F.array_join(F.array_sort(F.collect_set("source_tag")), "+").alias("_tags"),
        F.max("sign_was_negative").alias("_any_negative"),
        *[F.expr(_most(c, c)).alias(f"_most_{c}") for c in _TOLD])

    summed = F.col("_best.combine_mode") == "sum"
    told = [F.when(summed, F.col(f"_most_{c}")).otherwise(F.col(f"_best.{c}")).alias(c)
            for c in _TOLD]
    return merged.select(
        *filing,
        F.when(summed, F.col("_tags")).otherwise(F.col("_best.source_tag")).alias("source_tag"),
        *told,
        F.when(summed, F.col("_any_negative")).otherwise(F.col("_best.sign_was_negative"))
        .alias("sign_was_negative"),
        F.when(summed, F.col("_total")).otherwise(F.col("_best.value")).alias("value"))


def _pick_together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Anchoring and :func:`one_value_per_filing` over a single sort.

    The sort is (company, filing, period end, concept, part): anchoring is a window over its first
    three columns; repeats of a part, then the parts of a value, are folded by aggregates that
    find their rows side by side. ``_told`` packs the fact so that it compares in order of
    preference.
    """
    filing_day = ", ".join([*keys, "accession", "period_end"])
    value = [*keys, "accession", "period_end", "concept"]
    component = ("struct(tag_priority, source_tag, unit, period_start, filed_date, form, ticker, "
                 "company_name)")
    packed = rows.selectExpr(
        *keys, "accession", "period_end", "concept", "period_type = 'annual' as _annual",
        f"case when combine_mode = 'sum' then {component} end as _part",
        "struct(tag_priority, -value as _down, period_start is null as undated, period_start, "
        "unit, source_tag, filed_date, form, ticker, company_name, sign_was_negative, "
        "period_fiscal_year, filing_lag_days, restatement_eligible, value) as _told")
    ordered = packed.sortWithinPartitions(*value, "_part")

    units = ", ".join(f"'{u}'" for u in fixed.UNITS)
    anchored = ordered.selectExpr(
        "*", f"bool_or(_annual) over (partition by {filing_day}) as _full_year").filter(
        f"(_annual or (_full_year and accession is not null)) and _told.unit in ({units})")
    parts = anchored.groupBy(*value, "_part").agg(
        F.min("_told").alias("_best"), F.max("_told.value").alias("_largest"),
        F.max("_told.sign_was_negative").alias("_negative"))
    # As a window, since an aggregate that collects would be planned to hash its groups and, beyond
    # a few of them, to sort all rows again, twice. Only sums are told with all their tags.
    tagged = parts.selectExpr(
        "*", f"collect_set(_best.source_tag) over (partition by {', '.join(value)}) as _set",
    ).selectExpr(
        *parts.columns, "case when _part is not null then array_join(array_sort(_set), '+') end "
        "as _tags")
    whole = tagged.groupBy(*value).agg(
        F.max(F.col("_part").isNotNull()).alias("_summed"), F.min("_best").alias("_best"),
        F.expr(exact_sum("if(_part is null, null, _largest)")).alias("_total"),
        F.max("_negative").alias("_any_negative"), F.max("_tags").alias("_tags"),
        *[F.expr(_most(c, f"_best.{c}")).alias(f"_most_{c}") for c in _TOLD])
    told = {c: f"if(_summed, _most_{c}, _best.{c})" for c in _TOLD}
    rest = [f"{told.pop(c)} as {c}" for c in
            ("ticker", "company_name", "period_start", "filing_lag_days", "form",
             "restatement_eligible")]
    return whole.selectExpr(
        *value, *[f"{e} as {c}" for c, e in told.items()],
        "if(_summed, _tags, _best.source_tag) as source_tag",
        "if(_summed, _total, _best.value) as value",
        f"struct({', '.join(rest)}, if(_summed, _any_negative, _best.sign_was_negative) "
        "as sign_was_negative) as _rest")


# -- tag lineage and report versions ---------------------------------------------------------

def _oldest_first() -> list[Column]:
    return [F.col("filed_date").asc_nulls_last(), F.col("accession").asc_nulls_last()]


def _recency() -> Column:
    """Sort key of the newest filing; a missing accession loses a tie."""
    return F.struct("filed_date", F.col("accession").isNotNull().alias("_numbered"), "accession")


def _age() -> Column:
    """Sort key of report order; a missing accession comes last within a day."""
    return F.struct("filed_date", F.col("accession").isNull().alias("_unnumbered"), "accession")


def _trace_together(rows: DataFrame, keys: list[str]) -> DataFrame:
    # The fiscal year follows from the period end; naming it here makes this sort a refinement
    # of the one the canonical period needs.
    told = (f"partition by {', '.join(keys)}, period_fiscal_year, period_end, concept "
            "order by filed_date nulls last, accession nulls last")
    whole = f"({told} rows between unbounded preceding and unbounded following)"
    newest = "struct(filed_date, accession is not null, accession, source_tag as tag)"
    tagged = rows.selectExpr(
        "*", f"max({newest}) over {whole}.tag as latest_tag",
        f"cast(size(collect_set(source_tag) over {whole}) as bigint) as n_distinct_tags",
    ).withColumn("in_lineage", F.expr("source_tag = latest_tag"))
    inside = "case when in_lineage then {} end"
    value, filed = inside.format("value"), inside.format("filed_date")
    upto = f"({told} rows between unbounded preceding and current row)"
    return _only_in_lineage(tagged.selectExpr(
        "*", f"count_if(in_lineage) over {upto} as report_version",
        f"count_if(in_lineage) over {whole} as n_reports",
        f"first({value}, true) over {whole} as first_reported_value",
        f"last({value}, true) over {whole} as latest_reported_value",
        f"min({filed}) over {whole} as first_filed_date",
        f"max({filed}) over {whole} as latest_filed_date"))


def _trace_apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    series = [*keys, "concept", "period_end"]
    per_tag = rows.groupBy(*series, "source_tag").agg(
        F.max(_recency()).alias("_at"), F.count(F.lit(1)).alias("n_reports"),
        F.min_by("value", _age()).alias("first_reported_value"),
        F.max_by("value", _age()).alias("latest_reported_value"),
        F.min("filed_date").alias("first_filed_date"),
        F.max("filed_date").alias("latest_filed_date"))
    stats = ("n_reports", "first_reported_value", "latest_reported_value", "first_filed_date",
             "latest_filed_date")
    # Rows per series are now the distinct tag labels, a handful by the concept table.
    per_series = per_tag.groupBy(*series).agg(
        F.max(F.struct("_at", "source_tag", *stats)).alias("_last"),
        F.count(F.lit(1)).alias("n_distinct_tags"),
    ).select(*series, F.col("_last.source_tag").alias("latest_tag"), "n_distinct_tags",
             *[f"_last.{s}" for s in stats])

    traced = match(rows, per_series, series, "inner").withColumn(
        "in_lineage", F.col("source_tag") == F.col("latest_tag"))
    numbered = number_rows(traced, [*series, "in_lineage"], _oldest_first())
    return _only_in_lineage(numbered.withColumnRenamed("row_number", "report_version")
                            .drop("group_rows"))


def _only_in_lineage(stats: DataFrame) -> DataFrame:
    """Rows outside the lineage, and rows without an accession, carry no comparison."""
    names = ("report_version", "n_reports", "first_reported_value", "latest_reported_value",
             "first_filed_date", "latest_filed_date")
    kept = [c for c in stats.columns if c not in names]
    return stats.selectExpr(*kept, *[
        f"case when in_lineage and accession is not null then {n} end as {n}" for n in names])


# -- canonical period ------------------------------------------------------------------------
# A period end is supported by every concept first reported against it; the best supported one,
# the later on a tie, stands for its fiscal year.

def _canonical_together(rows: DataFrame, keys: list[str]) -> DataFrame:
    year = f"partition by {', '.join(keys)}, period_fiscal_year"
    return rows.selectExpr(
        "*", f"count_if(report_version = 1) over ({year}, period_end) as _support",
    ).selectExpr(
        "*", f"max(struct(_support, period_end)) over ({year}) as _top",
    ).selectExpr(
        *rows.columns, "case when _top._support > 0 then _top.period_end end "
        "as canonical_period_end")


def _canonical_apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    year = [*keys, "period_fiscal_year"]
    # One row per period end, then one per fiscal year: bounded by the days of a year.
    canonical = (rows.groupBy(*year, "period_end").agg(F.count_if(F.col("report_version") == 1).alias("_support"))
                 .filter("_support > 0").groupBy(*year)
                 .agg(F.max(F.struct("_support", "period_end")).alias("_top"))
                 .select(*year, F.col("_top.period_end").alias("canonical_period_end")))
    return match(rows, canonical, year, "left")


# -- restatement measures --------------------------------------------------------------------

def _finish(rows: DataFrame, keys: list[str]) -> DataFrame:
    moved = rows.withColumn("restatement_pct", F.expr(
        "try_divide(latest_reported_value - first_reported_value, abs(first_reported_value))"))
    made = {
        "tag_switch_detected": "n_distinct_tags > 1",
        "is_first_report": "report_version = 1 and period_end = canonical_period_end",
        "is_latest_report": "filed_date = latest_filed_date",
        "was_restated": f"coalesce(abs(restatement_pct) > {fixed.RESTATEMENT_TOLERANCE}D, false)",
    }
    columns = [*[k for k in keys if k not in PIT_COLUMNS], *PIT_COLUMNS]
    return moved.selectExpr(*[f"{made[c]} as {c}" if c in made else c for c in columns])
