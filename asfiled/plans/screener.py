"""The flat screener table and everything the dashboard derives from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed
from ..operators.selection import values_at_ranks

FLAGS = ("m_score_flag", "z_score_flag", "f_score_flag")


def _flagged() -> Column:
    return F.col("red_flag_count") > 0


def screener(scored: DataFrame, sectors: DataFrame, case_studies: DataFrame) -> DataFrame:
    """One row per company and fiscal year. The three scores already share a row, so no outer
    join of three tables is needed. The two dimensions are joined without a hint."""
    flagged = scored.withColumns({
        "m_score_flag": F.col("m_score") > fixed.BENEISH_CUTOFF,
        "z_score_flag": F.col("zone") == "distress",
        "f_score_flag": F.col("band") == "weak",
    })
    raised = [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in FLAGS]
    known = [F.col(f).isNotNull().cast("int") for f in FLAGS]
    named = (flagged.join(sectors.select("ticker", "gics_sector"), "ticker", "left")
             .join(case_studies.select(F.col("ticker").alias("_case"), "case_study_note"),
                   F.col("ticker") == F.col("_case"), "left"))
    return named.select(
        "entity_id", "ticker", "company_name", "gics_sector",
        F.col("_case").isNotNull().alias("is_case_study"), "case_study_note",
        "period_fiscal_year", "period_end", "m_score", "z_score", F.col("zone").alias("z_zone"),
        "f_score", F.col("band").alias("f_band"), *FLAGS,
        (raised[0] + raised[1] + raised[2]).alias("red_flag_count"),
        (known[0] + known[1] + known[2]).alias("models_scored"))


def combine_scores(m: DataFrame, z: DataFrame, f: DataFrame) -> DataFrame:
    """Separately stored scores brought together: a full outer join on company and year."""
    key = ["entity_id", "period_fiscal_year"]

    def side(df: DataFrame, tag: str, *columns: str) -> DataFrame:
        return df.select(*key, F.col("ticker").alias(f"_t{tag}"),
                         F.col("company_name").alias(f"_n{tag}"), *columns)

    joined = (side(m, "m", "m_score")
              .join(side(z, "z", F.col("period_end").alias("_pz"), "z_score", "zone"),
                    key, "full")
              .join(side(f, "f", F.col("period_end").alias("_pf"), "f_score", "band"),
                    key, "full"))
    return joined.select(
        "entity_id", F.coalesce("_tm", "_tz", "_tf").alias("ticker"),
        F.coalesce("_nm", "_nz", "_nf").alias("company_name"), "period_fiscal_year",
        F.coalesce("_pz", "_pf").alias("period_end"), "m_score", "z_score", "zone",
        "f_score", "band")


# -- interactive view ------------------------------------------------------------------------

def search(table: DataFrame, text: str = "", sector: str = "", cases_only: bool = False,
           min_flags: int = 0, first_year: int | None = None,
           last_year: int | None = None) -> DataFrame:
    wanted = F.col("red_flag_count") >= min_flags
    if text.strip():
        needle = text.strip().lower()
        wanted &= (F.contains(F.lower("ticker"), F.lit(needle))
                   | F.contains(F.lower("company_name"), F.lit(needle)))
    if sector:
        wanted &= F.col("gics_sector") == sector
    if cases_only:
        wanted &= F.col("is_case_study")
    if first_year:
        wanted &= F.col("period_fiscal_year") >= first_year
    if last_year:
        wanted &= F.col("period_fiscal_year") <= last_year
    return table.filter(wanted)


def sort_by(table: DataFrame, column: str, descending: bool = False,
            ties: tuple[str, ...] = ()) -> DataFrame:
    """Order by one column; text ignores case, null counts as the smallest value."""
    is_text = table.schema[column].dataType.typeName() == "string"
    key = F.lower(column) if is_text else F.col(column)
    leading = key.desc_nulls_last() if descending else key.asc_nulls_first()
    return table.orderBy(leading, *ties)


def page(table: DataFrame, column: str = "red_flag_count", descending: bool = True,
         number: int = 0, ties: tuple[str, ...] = ("entity_id", "period_fiscal_year"),
         rows: int = fixed.PAGE_ROWS) -> DataFrame:
    return sort_by(table, column, descending, ties).offset(number * rows).limit(rows)


def page_after(table: DataFrame, last: Row | None = None, column: str = "red_flag_count",
               descending: bool = True, ties: tuple[str, ...] = ("entity_id", "period_fiscal_year"),
               rows: int = fixed.PAGE_ROWS) -> DataFrame:
    """The page behind the row ``last``, the last one shown; the first page without one.

    A filter on the order's columns takes the place of an offset, so a deep page costs what the
    first one does: every task keeps ``rows`` rows. The columns must tell rows apart.
    """
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for name, down in ((column, descending), *((t, False) for t in ties)):
            text = name == column and table.schema[name].dataType.typeName() == "string"
            key = F.lower(name) if text else F.col(name)
            at = F.lit(last[name]).cast(table.schema[name].dataType)
            at = F.lower(at) if text else at
            # Null is the smallest value: last when descending, first otherwise.
            further = (at.isNotNull() & (key.isNull() | (key < at)) if down
                       else key.isNotNull() & (at.isNull() | (key > at)))
            beyond = beyond | (same & F.coalesce(further, F.lit(False)))
            same = same & key.eqNullSafe(at)
        table = table.filter(beyond)
    return sort_by(table, column, descending, ties).limit(rows)


def default_order(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("red_flag_count"), F.desc("period_fiscal_year"), "entity_id")


# -- figures ---------------------------------------------------------------------------------

def _share(condition: Column) -> Column:
    """Share of rows meeting a condition; a null condition does not meet it."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def _by_company(table: DataFrame) -> DataFrame:
    """Rows, flagged rows and flags of each company: distinct counts of companies become counts
    of rows, without a copy of the table for every distinct count."""
    flagged = F.coalesce(_flagged(), F.lit(False))
    return table.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flagged).alias("flagged"),
        F.count("red_flag_count").alias("counted"), F.sum("red_flag_count").alias("flags"),
        F.min("period_fiscal_year").alias("first"), F.max("period_fiscal_year").alias("last"))


def _companies(flagged: bool = False) -> Column:
    known = F.col("entity_id").isNotNull()
    return F.count_if(known & (F.col("flagged") > 0) if flagged else known)


def fleet_figures(table: DataFrame) -> DataFrame:
    return _by_company(table).agg(
        _companies().alias("companies_screened"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("company_years"),
        F.try_divide(F.sum("flagged"), F.sum("rows")).alias("red_flag_rate"),
        F.try_divide(F.sum("flags"), F.sum("counted")).alias("avg_red_flags"),
        _companies(flagged=True).alias("companies_flagged"))


def model_flag_rates(table: DataFrame) -> DataFrame:
    """Flag rate of each model over the rows it scored."""
    def rate(hit: Column, scored: str) -> Column:
        return F.try_divide(F.count_if(hit), F.count(scored))

    return table.agg(
        rate(F.col("m_score_flag"), "m_score_flag").alias("m_flag_rate"),
        rate(F.col("z_zone") == "distress", "z_zone").alias("z_distress_rate"),
        rate(F.col("f_band") == "weak", "f_band").alias("f_weak_rate"))


def coverage(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("company_years"),
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_coverage")
          for c in ("m_score", "z_score", "f_score")])


def _sector() -> Column:
    return F.coalesce("gics_sector", F.lit(fixed.NO_SECTOR)).alias("gics_sector")


def sector_figures(table: DataFrame) -> DataFrame:
    return table.groupBy(_sector()).agg(
        F.count(F.lit(1)).alias("company_years"), F.avg("m_score").alias("avg_m_score"),
        F.avg("z_score").alias("avg_z_score"), F.avg("red_flag_count").alias("avg_red_flags"),
        _share(_flagged()).alias("red_flag_rate"))


def sector_year_matrix(table: DataFrame, years: list[int]) -> DataFrame:
    """Average flags by sector (rows) and fiscal year (columns ``fy<year>``)."""
    return table.groupBy(_sector()).agg(*[
        F.avg(F.when(F.col("period_fiscal_year") == y, F.col("red_flag_count"))).alias(f"fy{y}")
        for y in years])


def sector_years(table: DataFrame) -> DataFrame:
    """Average flags by sector and fiscal year, for the years that are there."""
    return table.groupBy(_sector(), "period_fiscal_year").agg(
        F.avg("red_flag_count").alias("avg_flags"), F.count(F.lit(1)).alias("n"))


def case_study_flags(table: DataFrame) -> DataFrame:
    return table.filter(F.col("is_case_study") & _flagged()).agg(
        F.count(F.lit(1)).alias("case_study_red_flags"))


def span_and_share_labels(table: DataFrame) -> DataFrame:
    span = F.format_string(fixed.SPAN_LABEL, F.min("first"), F.max("last"))
    share = F.round(F.try_divide(_companies(flagged=True), _companies()) * 100, 0).cast("int")
    return _by_company(table).agg(
        span.alias("universe_span"),
        F.format_string(fixed.SHARE_LABEL, share).alias("any_flag_share"))


def counters(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("company_years"), F.countDistinct("ticker").alias("companies"),
        F.count_if(F.col("red_flag_count") >= 1).alias("one_flag_or_more"),
        F.count_if(F.col("red_flag_count") >= 2).alias("two_flags_or_more"))


def flag_rank(table: DataFrame) -> DataFrame:
    """Dense rank of tickers by total flags. The rank runs over the distinct totals only, a
    short list of small integers, and is joined back to the tickers."""
    totals = table.groupBy("ticker").agg(F.sum("red_flag_count").alias("total_red_flags"))
    distinct = totals.select("total_red_flags").distinct().withColumn(
        "red_flag_rank", F.dense_rank().over(W.orderBy(F.desc("total_red_flags"))))
    return totals.join(distinct, "total_red_flags").select(
        "ticker", "total_red_flags", "red_flag_rank")


def yearly_change(table: DataFrame) -> DataFrame:
    """Flag rate per fiscal year, the year before, and the change (null after a gap)."""
    rates = table.groupBy("period_fiscal_year").agg(_share(_flagged()).alias("red_flag_rate"))
    earlier = rates.select((F.col("period_fiscal_year") + 1).alias("period_fiscal_year"),
                           F.col("red_flag_rate").alias("previous_rate"))
    return rates.join(earlier, "period_fiscal_year", "left").withColumn(
        "change", F.col("red_flag_rate") - F.col("previous_rate"))


def histogram(table: DataFrame, column: str, bins: int = fixed.HISTOGRAM_BINS,
              clip: tuple[float, float] = fixed.HISTOGRAM_CLIP) -> DataFrame:
    """Equal-width bins between two rank percentiles; values outside go to the edge bins.

    The percentiles are exact values at ranks, found by narrowing; ``table`` is read, not moved.
    """
    n = F.col("group_rows")
    ends = values_at_ranks(table, [], column, {
        "low": F.floor(n.cast("double") * clip[0]) + 1,
        "high": F.ceil(n.cast("double") * clip[1])})
    low, high = (ends.filter(F.col("rank") == r).agg(F.max("value")).scalar()
                 for r in ("low", "high"))
    placed = table.filter(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("v"), low.alias("low"), high.alias("high"))
    width = F.when(F.col("high") == F.col("low"), 1.0).otherwise(F.col("high") - F.col("low"))
    spot = F.floor((F.col("v") - F.col("low")) / width * bins)
    binned = placed.select(
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), spot)).cast("int").alias("bin"),
        "low", "high", (~F.col("v").between(F.col("low"), F.col("high"))).alias("outside"))
    counted = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("outside").alias("n_clipped"))
    every = table.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_clipped", F.lit(0)).alias("n_clipped"),
        low.alias("low"), high.alias("high"))


# -- case studies and drill-through ----------------------------------------------------------

def spotlight(table: DataFrame, events: DataFrame) -> DataFrame:
    """Score history of the case-study companies with their disclosure dates and lead time."""
    ahead = events.filter("event_label = 'pre_disclosure'").select(
        "ticker", "as_of_date", "public_event_date")
    lead = F.datediff("public_event_date", "as_of_date") / F.lit(365.25)
    told = F.format_string(fixed.LEAD_LABEL, F.col("lead_time_years"))
    return (table.filter("is_case_study").join(ahead, "ticker", "left")
            .withColumn("lead_time_years", lead)
            .select("ticker", "company_name", "period_fiscal_year", "m_score", "z_score",
                    "f_score", "red_flag_count", "case_study_note", "as_of_date",
                    "public_event_date", "lead_time_years",
                    told.alias("lead_time_label"),
                    F.when(F.col("company_name").isNotNull() & F.col("as_of_date").isNotNull()
                           & told.isNotNull(), F.format_string(
                               fixed.SPOTLIGHT_TITLE, "company_name", "ticker",
                               F.date_format("as_of_date", fixed.TITLE_DATE), told))
                    .alias("title"),
                    _flagged().cast("int").alias("is_flagged_year")))


def drill_through(table: DataFrame, detail: DataFrame) -> DataFrame:
    """Component view of a company-year: threshold labels, signals passed, title."""
    signals = [c for c in detail.columns if c.startswith("signal_")]
    passed = F.col(signals[0])
    for name in signals[1:]:
        passed = passed + F.col(name)

    def label(column: str, above: float) -> Column:
        return F.when(F.col(column) > above, fixed.ELEVATED).otherwise(fixed.NORMAL)

    keyed = table.select(F.concat_ws("-", "entity_id", "period_fiscal_year").alias("detail_key"),
                         "red_flag_count")
    return detail.join(keyed, "detail_key").select(
        "detail_key", "red_flag_count",
        label("aqi", fixed.AQI_ELEVATED_ABOVE).alias("aqi_level"),
        label("tata", fixed.TATA_ELEVATED_ABOVE).alias("tata_level"),
        passed.alias("signals_passed"),
        F.concat("company_name", F.lit(" — FY"), F.col("period_fiscal_year").cast("string"))
        .alias("title"))


def selected_value(table: DataFrame, column: str, fallback: str) -> DataFrame:
    """The one value of a column, or the fallback when the selection holds several."""
    return table.agg(F.when(F.countDistinct(column) == 1, F.max(column))
                     .otherwise(fallback).alias(column))


# -- restatements and digits -----------------------------------------------------------------

def restatement_board(pit: DataFrame) -> DataFrame:
    """Restatement rate and worst move per company over eligible concepts."""
    eligible = pit.filter("restatement_eligible and in_lineage")
    return eligible.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("reports"),
        F.avg(F.col("was_restated").cast("int")).alias("restatement_rate"),
        F.max(F.abs("restatement_pct")).alias("worst_move"))


def leading_digits(staged: DataFrame) -> DataFrame:
    """First-digit counts of reported values against the logarithmic law, and chi-square terms."""
    # The shortest decimal form of a number shows its first significant digit.
    digit = F.regexp_extract(F.col("value").cast("string"), "[1-9]", 0).cast("int")
    counted = (staged.filter(F.col("value") != 0).groupBy(digit.alias("digit"))
               .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(W.partitionBy())  # nine rows
    expected = F.log10(1 + 1 / F.col("digit"))
    return counted.withColumn("share", F.col("n") / total).withColumn(
        "expected_share", expected).withColumn(
        "chi_square_term",
        F.pow(F.col("n") - total * F.col("expected_share"), F.lit(2))
        / (total * F.col("expected_share")))
