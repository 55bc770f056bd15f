"""Every registered query: name -> (Spark callable over ``Inputs``, DuckDB SQL or ``None``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asfiled import fixed
from asfiled.durable import fresh_path
from asfiled.operators import bitemporal, clustered, knowledge, pricing, staging, volume, wide
from asfiled.plans import accruals, backtest, observed, quality, scoring, universe
from asfiled.plans import screener as screen
from asfiled.sources import readers, writers

from .inputs import Inputs
from .oracle import after

Build = Callable[[Inputs], DataFrame]
REGISTRY: dict[str, tuple[Build, str | None]] = {}


def register(name: str, sql: str | None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        REGISTRY[name] = (build, sql)
        return build
    return keep


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Averages depend on summation order in the last digits; both engines round them."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def _round_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def _names(df: DataFrame) -> DataFrame:
    """Arrays as text, so that the comparison sees plain columns."""
    lists = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({c: F.concat_ws(",", c) for c in lists})


_INDEX_SQL = "dsri, gmi, aqi, sgi, depi, sgai, tata, lvgi"
_FACTOR_SQL = "x1, x2, x3, x4, x5"
_SIGNAL_SQL = ", ".join(scoring.SIGNAL_COLUMNS)
_WHO = "entity_id, ticker, company_name"


def _missing_sql(columns: tuple[str, ...], prefix: str = "") -> str:
    parts = ", ".join(f"if({prefix}{c} is null, '{c}', null)" for c in columns)
    return f"concat_ws(',', {parts})"


# -- sources and sinks -----------------------------------------------------------------------

FACT_COLUMNS = ("entity_id, ticker, company_name, concept, source_tag, tag_priority, unit, "
                "period_start, period_end, fiscal_year, fiscal_period, form, filed_date, "
                "accession, frame, value")


@register("write_and_read_facts", after("facts", sql=f"select {FACT_COLUMNS} from facts"))
def _(x: Inputs) -> DataFrame:
    path = fresh_path(x.spark, "facts")
    companies = x.companies.select("entity_id", "ticker", "company_name")
    writers.write_facts(x.facts.drop("ticker", "company_name"), companies, path)
    return readers.read_facts(x.spark, path)


@register("price_history_shaped", after("facts", sql="select ticker, date, close from prices"))
def _(x: Inputs) -> DataFrame:
    vendor = x.raw_prices.select("ticker", F.col("date").cast("timestamp").alias("Date"),
                                 F.col("close").alias("Close"))
    path = fresh_path(x.spark, "prices")
    writers.write_prices(readers.price_frame(vendor), path)
    return readers.read_prices(x.spark, path)


@register("sector_csv", after("facts", sql="select ticker, gics_sector from sectors"))
def _(x: Inputs) -> DataFrame:
    path = fresh_path(x.spark, "sectors")
    writers.write_constituents(x.sectors.withColumn("ticker", F.lower("ticker")), path)
    return staging.stage_sectors(readers.read_sectors(x.spark, path))


@register("concept_seed_coverage", after("facts", sql="""
select concept, if(concept in ('receivables', 'current_assets', 'total_assets', 'ppe_net',
    'current_liabilities', 'total_liabilities', 'long_term_debt', 'retained_earnings', 'equity',
    'inventory'), 'instant', 'duration') as kind,
  if(concept = 'cogs', 'sum', 'best') as combine, count(*) as n_facts
from facts group by all"""))
def _(x: Inputs) -> DataFrame:
    folder = fresh_path(x.spark, "seeds")
    writers.write_seeds(x.spark, folder)
    concepts = readers.read_concepts(x.spark, f"{folder}/concepts")
    return x.facts.join(concepts, "concept").groupBy("concept", "kind", "combine").agg(
        F.count(F.lit(1)).alias("n_facts"))


@register("flatten_filing_json", after("facts", sql="""
select entity_id, concept, source_tag, tag_priority, unit, period_start, period_end,
  fiscal_year, fiscal_period, form, filed_date, accession, frame, value from facts"""))
def _(x: Inputs) -> DataFrame:
    """One nested document per fact, with an unmapped tag, a foreign taxonomy and an observation
    before the first fiscal year around it; the flattener must return exactly the facts."""
    told = F.struct(
        F.col("period_start").cast("string").alias("start"),
        F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"),
        F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"),
        F.col("fiscal_period").alias("fp"), "form",
        F.col("filed_date").cast("string").alias("filed"), "frame")
    early = told.withField("fy", F.lit(2009))
    body = F.struct(F.create_map("unit", F.array(told, early)).alias("units"))
    tags = F.create_map("source_tag", body, F.lit("SomeUnmappedTag"), body)
    document = F.to_json(F.struct(F.create_map(
        F.lit("us-gaap"), tags, F.lit("dei"), tags).alias("facts")))
    return readers.flatten_filings(x.facts.select("entity_id", document.alias("payload")))


@register("company_map_json", after("facts", sql="""
select entity_id, ticker || suffix as ticker, company_name, position
from company, (values ('-B', 0), ('', 1)) t(suffix, position)"""))
def _(x: Inputs) -> DataFrame:
    """Maps of two share classes; the one that comes first in the map is the later by name."""
    def entry(ticker: F.Column) -> F.Column:
        return F.struct(F.col("s").alias("cik_str"), ticker.alias("ticker"),
                        F.col("company_name").alias("title"))

    return readers.companies_from_map(x.companies.select(F.to_json(F.create_map(
        F.lit("0"), entry(F.concat("ticker", F.lit("-B"))), F.lit("1"), entry(F.col("ticker")))
    ).alias("payload")))


@register("rejected_filings", after("facts", sql="""
select entity_id, case s % 6 when 0 then 'malformed' when 1 then 'no facts' when 2 then 'empty'
  when 3 then 'no mapped tags' else 'partly readable' end as reason
from company where s % 6 < 5"""))
def _(x: Inputs) -> DataFrame:
    """One document of each kind of damage, and whole ones, over all companies."""
    one = '{"facts": {"us-gaap": {"%s": {"units": {"USD": [{"end": "2015-12-31", "val": %s}]}}}}}'
    payload = (F.when(F.col("s") % 6 == 0, '["no document"')
               .when(F.col("s") % 6 == 1, '{"facts": {"us-gaap": {}}}')
               .when(F.col("s") % 6 == 2, F.lit("  ")).when(F.col("s") % 6 == 3, one % ("Odd", 1))
               .when(F.col("s") % 6 == 4, one % ("Revenues", '"much"'))
               .otherwise(one % ("Revenues", 1)))
    return readers.rejected_documents(x.companies.select("entity_id", payload.alias("payload")))


@register("filings_to_facts", after("facts", sql=f"select {FACT_COLUMNS} from facts"))
def _(x: Inputs) -> DataFrame:
    """Documents of many tags, units and observations, one file each, through reading, flattening,
    names, write and read."""
    told = F.struct(
        F.col("period_start").cast("string").alias("start"),
        F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"),
        F.col("accession").alias("accn"), F.col("fiscal_year").alias("fy"),
        F.col("fiscal_period").alias("fp"), "form",
        F.col("filed_date").cast("string").alias("filed"), "frame")

    def folded(df: DataFrame, by: list[str], key: str, value: F.Column, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.map_from_entries(
            F.collect_list(F.struct(key, value))).alias(name))

    units = x.facts.groupBy("entity_id", "source_tag", "unit").agg(
        F.collect_list(told).alias("observations"))
    tags = folded(units, ["entity_id", "source_tag"], "unit", F.col("observations"), "units")
    documents = folded(tags, ["entity_id"], "source_tag", F.struct("units"), "tags").select(
        "entity_id", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "tags").alias("facts")))
        .alias("payload"))
    folder, path = fresh_path(x.spark, "documents"), fresh_path(x.spark, "facts")
    documents.write.partitionBy("entity_id").text(folder)
    writers.write_facts(readers.flatten_filings(readers.read_documents(x.spark, folder)),
                        x.companies.select("entity_id", "ticker", "company_name"), path)
    return readers.read_facts(x.spark, path)


@register("event_properties_json", """
select event_type, key as property, count(*) as n, cast(sum(cast(val as bigint)) as bigint) as total
from (select event_type, unnest(json_keys(props)) as key,
        json_extract_string(props, '$.' || unnest(json_keys(props))) as val from events)
group by all""")
def _(x: Inputs) -> DataFrame:
    parsed = x.table("events").select(
        "event_type", F.explode(F.from_json("props", "map<string, bigint>"))
        .alias("property", "val"))
    return parsed.groupBy("event_type", "property").agg(
        F.count(F.lit(1)).alias("n"), F.sum("val").alias("total"))


@register("model_by_name", after("staged", sql="""
select form, period_type, count(*) as n, min(filed_date) as first_filed from staged group by all"""))
def _(x: Inputs) -> DataFrame:
    x.staged.createOrReplaceTempView("staged_facts")
    return x.spark.sql("select form, period_type, count(*) as n, min(filed_date) as first_filed "
                       "from staged_facts group by form, period_type")


_SCREENER_SQL = """entity_id, ticker, company_name, gics_sector, is_case_study,
  case_study_note, period_fiscal_year, period_end, m_score, z_score, z_zone, f_score, f_band,
  m_score_flag, z_score_flag, f_score_flag, red_flag_count, models_scored"""


@register("export_screener_csv", after("screener", sql=f"""
select {_SCREENER_SQL}, entity_id || '-' || period_fiscal_year as detail_key from screener"""))
def _(x: Inputs) -> DataFrame:
    path = fresh_path(x.spark, "screener_csv")
    writers.write_screener(x.screener, path)
    return readers.read_screener(x.spark, path)


_DETAIL_SQL = after("scored", sql=f"""
select {_WHO}, period_fiscal_year, entity_id || '-' || period_fiscal_year as detail_key,
  {_INDEX_SQL}, {_FACTOR_SQL}, {_SIGNAL_SQL} from scored""")


@register("export_score_detail_csv", _DETAIL_SQL)
def _(x: Inputs) -> DataFrame:
    path, detail = fresh_path(x.spark, "detail_csv"), scoring.score_detail(x.scored)
    writers.write_score_detail(detail, path)
    return x.spark.read.csv(path, schema=detail.schema, header=True)


@register("score_detail", _DETAIL_SQL)
def _(x: Inputs) -> DataFrame:
    return scoring.score_detail(x.scored)


@register("index_constituents", after("facts", sql="""
select replace(ticker, 'T', 'T-') as ticker, company_name, gics_sector from sectors"""))
def _(x: Inputs) -> DataFrame:
    page = x.sectors.select(F.regexp_replace("ticker", "^T", "T.").alias("Symbol"),
                            F.col("company_name").alias("Security"),
                            F.col("gics_sector").alias("GICS Sector"))
    path = fresh_path(x.spark, "constituents")
    writers.write_constituents(readers.constituents(page), path)
    return readers.read_sectors(x.spark, path)


# -- projections and filters -----------------------------------------------------------------

_STAGED_SQL = """entity_id, ticker, company_name, concept, source_tag, tag_priority, unit,
  period_start, period_end, filed_date, form, accession, period_fiscal_year, period_days,
  period_type, filing_lag_days, restatement_eligible, combine_mode, sign_convention, value,
  sign_was_negative"""


@register("stage_facts", after("staged", sql=f"select {_STAGED_SQL} from staged"))
def _(x: Inputs) -> DataFrame:
    return x.staged


@register("stage_prices", after("facts", sql="""
select ticker, date as price_date, close from prices where close is not null"""))
def _(x: Inputs) -> DataFrame:
    return x.prices


@register("resolve_tags", after("facts", sql="""
select source_tag, concept, tag_priority, count(*) as n from facts group by all"""))
def _(x: Inputs) -> DataFrame:
    tags = x.facts.groupBy("source_tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(staging.tag_table(x.spark), "source_tag")


@register("fiscal_year_of_period", after("staged", sql="""
select period_fiscal_year, cast(year(period_end) as integer) as calendar_year, count(*) as n
from staged group by all"""))
def _(x: Inputs) -> DataFrame:
    return x.staged.groupBy("period_fiscal_year", F.year("period_end").alias("calendar_year")).agg(
        F.count(F.lit(1)).alias("n"))


@register("period_classes", after("staged", sql="""
select period_type, count(*) as n, min(period_days) as shortest, max(period_days) as longest,
  min(filing_lag_days) as quickest, max(filing_lag_days) as slowest from staged group by all"""))
def _(x: Inputs) -> DataFrame:
    return x.staged.groupBy("period_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("period_days").alias("shortest"),
        F.max("period_days").alias("longest"), F.min("filing_lag_days").alias("quickest"),
        F.max("filing_lag_days").alias("slowest"))


@register("sign_normalised", after("staged", sql="""
select entity_id, concept, period_end, accession, value from staged where sign_was_negative"""))
def _(x: Inputs) -> DataFrame:
    return x.staged.filter("sign_was_negative").select(
        "entity_id", "concept", "period_end", "accession", "value")


@register("staging_thresholds", after("staged", sql="""
select period_fiscal_year, count(*) as n from staged
where period_fiscal_year >= 2012 and filing_lag_days >= 60 group by all"""))
def _(x: Inputs) -> DataFrame:
    staged = staging.stage_facts(x.facts, min_fiscal_year=2012, min_filing_lag_days=60)
    return staged.groupBy("period_fiscal_year").agg(F.count(F.lit(1)).alias("n"))


_TOLD_SQL = """entity_id, ticker, company_name, concept, source_tag, period_start, period_end,
  period_fiscal_year, filed_date, filing_lag_days, form, accession, value,
  restatement_eligible, sign_was_negative"""


@register("annual_anchoring", after("pit", sql="""
select entity_id, concept, source_tag, period_start, period_end, accession, period_type, value
from kept"""))
def _(x: Inputs) -> DataFrame:
    kept = bitemporal.anchor_to_annual(x.staged, ["entity_id"])
    return kept.filter(F.col("unit").isin(*fixed.UNITS)).select(
        "entity_id", "concept", "source_tag", "period_start", "period_end", "accession",
        "period_type", "value")


@register("one_value_per_filing", after("pit", sql=f"select {_TOLD_SQL} from told_once"))
def _(x: Inputs) -> DataFrame:
    kept = bitemporal.anchor_to_annual(x.staged, ["entity_id"])
    return bitemporal.one_value_per_filing(kept, ["entity_id"]).select(
        *[c.strip() for c in _TOLD_SQL.split(",")])


_PIT_SQL = ", ".join(bitemporal.PIT_COLUMNS)


@register("financials_pit", after("pit", sql=f"select {_PIT_SQL} from pit"))
def _(x: Inputs) -> DataFrame:
    return x.build_pit()


@register("financials_pit_heavy_companies", after("pit", sql=f"select {_PIT_SQL} from pit"))
def _(x: Inputs) -> DataFrame:
    """The same table with a row bound so low that most companies take the split plan."""
    mean = x.facts.count() // max(1, x.companies.count())
    return x.build_pit(row_limit=mean)


@register("tag_lineage", after("pit", sql="""
select entity_id, concept, period_end, latest_tag, n_distinct_tags, tag_switch_detected,
  count(*) as n_filings, count(*) filter (where in_lineage) as n_in_lineage
from pit group by all"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.groupBy("entity_id", "concept", "period_end", "latest_tag", "n_distinct_tags",
                         "tag_switch_detected").agg(
        F.count(F.lit(1)).alias("n_filings"), F.count_if("in_lineage").alias("n_in_lineage"))


@register("distinct_tags_by_concept", after("pit", sql="""
select concept, count(distinct source_tag) as n_tags, count(distinct entity_id) as n_companies
from pit group by all"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.groupBy("concept").agg(F.countDistinct("source_tag").alias("n_tags"),
                                        F.countDistinct("entity_id").alias("n_companies"))


@register("restatements", after("pit", sql="""
select entity_id, concept, period_end, accession, report_version, n_reports,
  first_reported_value, latest_reported_value, restatement_pct from pit where was_restated"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.filter("was_restated").select(
        "entity_id", "concept", "period_end", "accession", "report_version", "n_reports",
        "first_reported_value", "latest_reported_value", "restatement_pct")


@register("latest_reports", after("pit", sql="""
select period_fiscal_year, concept, count(*) as n, count(*) filter (where is_latest_report)
  as n_latest, max(report_version) as most_versions from pit group by all"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.groupBy("period_fiscal_year", "concept").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_latest_report").alias("n_latest"),
        F.max("report_version").alias("most_versions"))


@register("canonical_period", after("pit", sql="""
select distinct entity_id, period_fiscal_year, period_end from pit where is_first_report"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.filter("is_first_report").select(
        "entity_id", "period_fiscal_year", "period_end").distinct()


@register("summed_components", after("pit", sql="""
select entity_id, concept, period_end, accession, source_tag, value from pit
where source_tag like '%+%'"""))
def _(x: Inputs) -> DataFrame:
    return x.pit.filter(F.col("source_tag").like("%+%")).select(
        "entity_id", "concept", "period_end", "accession", "source_tag", "value")


@register("foreign_filers", after("years", sql="select entity_id from abroad"))
def _(x: Inputs) -> DataFrame:
    return x.pit.filter(F.col("form").isin(*fixed.FOREIGN_FORMS)).select("entity_id").distinct()


# -- companies -------------------------------------------------------------------------------

def _listed_companies(x: Inputs) -> DataFrame:
    """Index members by number, every third one listed once more at the end, and one in lower case."""
    again = F.when(F.col("s") % 3 == 0, F.struct((F.col("s") + 10 ** 9).alias("at"), "ticker"))
    own = F.struct(F.col("s").cast("long").alias("at"),
                   F.when(F.col("s") % 5 == 0, F.concat(F.lit(" "), F.lower("ticker"))).otherwise(
                       F.col("ticker")).alias("ticker"))
    return x.companies.select(F.explode(F.array_compact(F.array(own, again))).alias("_l")).select("_l.*")


_CASE_LIST = ", ".join(f"({i}, '{t}')" for i, t in enumerate(universe.LISTS["cases"]))


@register("full_universe", after("facts", sql=f"""
select row_number() over (order by lst, nth) as rank, ticker from (
  select 0 as lst, s as nth, ticker from company
  union all select 1, i, t from (values {_CASE_LIST}) c(i, t))"""))
def _(x: Inputs) -> DataFrame:
    """The order of lists that lie in several CSV files, through to numbers."""
    folder = fresh_path(x.spark, "lists")
    (_listed_companies(x).repartitionByRange(3, "at").sortWithinPartitions("at").select("ticker")
     .write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{folder}/sp500.csv"))
    return universe.ranked(universe.named_universe(x.spark, "full", folder))


def _asked(x: Inputs) -> DataFrame:
    """Tickers requested of the ingest: every sector member, the other share class of every
    second company, and as many names nobody has."""
    other = F.when(F.substring("ticker", -1, 1).cast("int") % 2 == 0, F.concat("ticker", F.lit("-B")))
    return x.sectors.select(F.explode(F.array_compact(F.array(
        "ticker", F.concat("ticker", F.lit("X")), other))).alias("ticker"))


def _classes(x: Inputs) -> DataFrame:
    """Company map in which a second share class stands before the first one."""
    return x.companies.select("entity_id", F.posexplode(F.array(
        F.concat("ticker", F.lit("-B")), F.col("ticker"))).alias("_place", "ticker"),
        "company_name", "s").select(
        "entity_id", "ticker", "company_name", (F.col("s") * 2 + F.col("_place")).alias("position"))


@register("selected_companies", after("facts", sql="""
select entity_id, ticker || if(s % 2 = 0, '-B', '') as ticker, company_name,
  s * 2 + s % 2 as position from company"""))
def _(x: Inputs) -> DataFrame:
    return universe.select_companies(_classes(x), _asked(x))


@register("missing_tickers", after("facts", sql="""
select ticker || 'X' as ticker from company
union all select ticker from company where s % 2 = 0"""))
def _(x: Inputs) -> DataFrame:
    return universe.missing_tickers(_classes(x), _asked(x))


# -- wide table, prices, scores --------------------------------------------------------------

_WIDE = ("entity_id", "period_end", "period_fiscal_year", "ticker", "company_name", "form",
         *wide.CONCEPTS, "shares", "shares_current_basis", "gross_profit_reported",
         "total_liabilities_reported", "accrual_known_date")


@register("company_years", after("years", sql=f"select {', '.join(_WIDE)} from years"))
def _(x: Inputs) -> DataFrame:
    return wide.company_years(x.pit).select(*_WIDE)


@register("clustered_company_years", after("years", sql=f"select {', '.join(_WIDE)} from years"))
def _(x: Inputs) -> DataFrame:
    """Company-years from a table that is bucketed by company: one stage, no exchange."""
    parts = clustered.write_clustered(x.pit, "pit", buckets=8)
    return clustered.over_parts(parts, wide.company_years).select(*_WIDE)


@register("previous_year", after("years", sql="""
select a.entity_id, a.period_fiscal_year, b.revenue as revenue_before, b.sga as sga_before,
  b.total_liabilities as liabilities_before
from years a left join years b
  on b.entity_id = a.entity_id and b.period_fiscal_year = a.period_fiscal_year - 1"""))
def _(x: Inputs) -> DataFrame:
    paired = wide.with_previous_year(wide.company_years(x.pit),
                                     ("revenue", "sga", "total_liabilities"))
    return paired.select("entity_id", "period_fiscal_year",
                         F.col("previous.revenue").alias("revenue_before"),
                         F.col("previous.sga").alias("sga_before"),
                         F.col("previous.total_liabilities").alias("liabilities_before"))


@register("nearest_price", after("scored", sql="""
select entity_id, y.period_end, price_date, price_at_period_end
from years y left join quoted using (entity_id, period_end)"""))
def _(x: Inputs) -> DataFrame:
    asked = x.scored.select("entity_id", "ticker", "period_end")
    return pricing.with_close(
        asked, pricing.fold_prices(x.prices), F.col("period_end"), "backward", "price_date",
        "price_at_period_end").drop("ticker")


@register("price_on_or_after_filing", after("accruals", sql="""
select entity_id, accession, filed_date, min(price_date) as price_date, arg_min(close, price_date) as close
from (select distinct entity_id, ticker, accession, filed_date from pit) f
left join quotes q on q.ticker = f.ticker and price_date between filed_date and filed_date + 10
group by all"""))
def _(x: Inputs) -> DataFrame:
    filings = x.pit.select("entity_id", "ticker", "accession", "filed_date").distinct()
    return pricing.with_close(
        filings, pricing.fold_prices(x.prices), F.col("filed_date"), "forward", "price_date",
        "close").select("entity_id", "accession", "filed_date", "price_date", "close")


_BENEISH_SQL = after("scored", sql=f"""
select {_WHO}, period_fiscal_year, {_INDEX_SQL},
  {_missing_sql(scoring.INDICES)} as missing_inputs, m_score from scored""")


@register("beneish_m_score", _BENEISH_SQL)
def _(x: Inputs) -> DataFrame:
    return _names(scoring.beneish(scoring.scored_company_years(x.pit, x.prices)))


@register("altman_z_score", after("scored", sql=f"""
select {_WHO}, period_end, period_fiscal_year, price_date, price_at_period_end,
  market_value_of_equity, {_FACTOR_SQL}, {_missing_sql(scoring.FACTORS)} as missing_inputs,
  z_score, zone from scored"""))
def _(x: Inputs) -> DataFrame:
    return _names(scoring.altman(scoring.scored_company_years(x.pit, x.prices)))


@register("piotroski_f_score", after("scored", sql=f"""
select {_WHO}, period_end, period_fiscal_year, {_SIGNAL_SQL},
  replace({_missing_sql(scoring.SIGNAL_COLUMNS)}, 'signal_', '') as missing_signals,
  f_score, band from scored"""))
def _(x: Inputs) -> DataFrame:
    return _names(scoring.piotroski(scoring.scored_company_years(x.pit, x.prices)))


@register("facts_to_scores", after("scored", sql="""
select entity_id, period_fiscal_year, m_score, z_score, zone, f_score, band from scored"""))
def _(x: Inputs) -> DataFrame:
    """From facts to all three scores in one plan, nothing written in between."""
    return scoring.scored_company_years(x.build_pit(), x.prices).select(
        "entity_id", "period_fiscal_year", "m_score", "z_score", "zone", "f_score", "band")


@register("foreign_filer_exclusion", after("scored", sql="""
select entity_id, period_fiscal_year, price_at_period_end, market_value_of_equity, x1, x5,
  z_score from scored join abroad using (entity_id)"""))
def _(x: Inputs) -> DataFrame:
    return x.scored.filter("is_foreign_filer").select(
        "entity_id", "period_fiscal_year", "price_at_period_end", "market_value_of_equity",
        "x1", "x5", "z_score")


# -- screener --------------------------------------------------------------------------------

@register("screener", after("screener", sql=f"select {_SCREENER_SQL} from screener"))
def _(x: Inputs) -> DataFrame:
    return screen.screener(x.scored, staging.stage_sectors(x.sectors), x.case_studies)


@register("combine_separate_scores", after("scored", sql=f"""
select {_WHO}, period_fiscal_year, period_end, m_score, z_score, zone, f_score, band
from scored"""))
def _(x: Inputs) -> DataFrame:
    return screen.combine_scores(scoring.beneish(x.scored), scoring.altman(x.scored),
                                 scoring.piotroski(x.scored))


@register("search_companies", after("screener", sql=f"""
select {_SCREENER_SQL} from screener where (lower(ticker) like '%t1%'
  or lower(company_name) like '%t1%') and red_flag_count >= 1
  and period_fiscal_year between 2011 and 2015"""))
def _(x: Inputs) -> DataFrame:
    return screen.search(x.screener, " T1", min_flags=1, first_year=2011, last_year=2015)


@register("search_sector_cases", after("screener", sql=f"""
select {_SCREENER_SQL} from screener where is_case_study
  and gics_sector = (select min(gics_sector) from screener where is_case_study)"""))
def _(x: Inputs) -> DataFrame:
    first = x.screener.filter("is_case_study").agg(F.min("gics_sector")).head()[0]
    return screen.search(x.screener, sector=first or "", cases_only=True)


@register("sort_screener", after("screener", sql=f"""
select {_SCREENER_SQL} from screener order by lower(gics_sector) nulls first, entity_id"""))
def _(x: Inputs) -> DataFrame:
    return screen.sort_by(x.screener, "gics_sector", ties=("entity_id", "period_fiscal_year"))


@register("default_ranking", after("screener", sql=f"""
select {_SCREENER_SQL} from screener order by red_flag_count desc, period_fiscal_year desc"""))
def _(x: Inputs) -> DataFrame:
    return screen.default_order(x.screener)


@register("screener_page", after("screener", sql=f"""
select {_SCREENER_SQL} from screener
order by m_score desc nulls last, entity_id, period_fiscal_year limit 50 offset 50"""))
def _(x: Inputs) -> DataFrame:
    return screen.page(x.screener, "m_score", number=1)


@register("screener_pages", after("screener", sql=f"""
select {_SCREENER_SQL} from screener
order by m_score desc nulls last, entity_id, period_fiscal_year limit 30 offset 60"""))
def _(x: Inputs) -> DataFrame:
    """The third page, each found from the last row of the one before."""
    last = None
    for _page in range(2):
        last = screen.page_after(x.screener, last, "m_score", rows=30).tail(1)[0]
    return screen.page_after(x.screener, last, "m_score", rows=30)


@register("restatement_board", after("pit", sql=f"""
select ticker, count(*) as reports, {_round_sql('restatement_rate')}, max(worst) as worst_move
from (select ticker, avg(cast(was_restated as integer)) over (partition by ticker)
        as restatement_rate, abs(restatement_pct) as worst
      from pit where restatement_eligible and in_lineage)
group by ticker, restatement_rate"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.restatement_board(x.pit), "restatement_rate")


@register("score_coverage", after("screener", sql="""
select count(*) as company_years, round(count(m_score) / count(*), 6) as m_score_coverage,
  round(count(z_score) / count(*), 6) as z_score_coverage,
  round(count(f_score) / count(*), 6) as f_score_coverage from screener"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.coverage(x.screener), "m_score_coverage", "z_score_coverage",
                   "f_score_coverage")


@register("fleet_figures", after("screener", sql="""
select count(distinct entity_id) as companies_screened, count(*) as company_years,
  round(avg(if(red_flag_count > 0, 1, 0)), 6) as red_flag_rate,
  round(avg(red_flag_count), 6) as avg_red_flags,
  count(distinct if(red_flag_count > 0, entity_id, null)) as companies_flagged from screener"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.fleet_figures(x.screener), "red_flag_rate", "avg_red_flags")


@register("model_flag_rates", after("screener", sql="""
select round(count(*) filter (where m_score_flag) / count(m_score_flag), 6) as m_flag_rate,
  round(count(*) filter (where z_zone = 'distress') / count(z_zone), 6) as z_distress_rate,
  round(count(*) filter (where f_band = 'weak') / count(f_band), 6) as f_weak_rate
from screener"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.model_flag_rates(x.screener), "m_flag_rate", "z_distress_rate",
                   "f_weak_rate")


@register("sector_figures", after("screener", sql="""
select coalesce(gics_sector, '(no sector data)') as gics_sector, count(*) as company_years,
  round(avg(m_score), 6) as avg_m_score, round(avg(z_score), 6) as avg_z_score,
  round(avg(red_flag_count), 6) as avg_red_flags,
  round(avg(if(red_flag_count > 0, 1, 0)), 6) as red_flag_rate from screener group by 1"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.sector_figures(x.screener), "avg_m_score", "avg_z_score",
                   "avg_red_flags", "red_flag_rate")


@register("sector_year_matrix", after("screener", sql="select "
          "coalesce(gics_sector, '(no sector data)') as gics_sector, " + ", ".join(
              f"round(avg(red_flag_count) filter (where period_fiscal_year = {y}), 6) as fy{y}"
              for y in range(2010, 2017)) + " from screener group by 1"))
def _(x: Inputs) -> DataFrame:
    years = list(range(2010, 2017))
    return rounded(screen.sector_year_matrix(x.screener, years), *[f"fy{y}" for y in years])


@register("sector_years", after("screener", sql="""
select coalesce(gics_sector, '(no sector data)') as gics_sector, period_fiscal_year,
  round(avg(red_flag_count), 6) as avg_flags, count(*) as n from screener group by 1, 2"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.sector_years(x.screener), "avg_flags")


@register("case_study_flags", after("screener", sql="""
select count(*) as case_study_red_flags from screener where is_case_study and red_flag_count > 0
"""))
def _(x: Inputs) -> DataFrame:
    return screen.case_study_flags(x.screener)


@register("span_and_share_labels", after("screener", sql="""
select 'FY ' || min(period_fiscal_year) || '–' || max(period_fiscal_year) as universe_span,
  cast(round(count(distinct if(red_flag_count > 0, entity_id, null)) * 100.0
    / count(distinct entity_id)) as integer) || '% of screened fleet' as any_flag_share
from screener"""))
def _(x: Inputs) -> DataFrame:
    return screen.span_and_share_labels(x.screener)


@register("screener_counters", after("screener", sql="""
select count(*) as company_years, count(distinct ticker) as companies,
  count(*) filter (where red_flag_count >= 1) as one_flag_or_more,
  count(*) filter (where red_flag_count >= 2) as two_flags_or_more from screener"""))
def _(x: Inputs) -> DataFrame:
    return screen.counters(x.screener)


@register("flag_rank", after("screener", sql="""
select ticker, cast(sum(red_flag_count) as bigint) as total_red_flags,
  cast(dense_rank() over (order by sum(red_flag_count) desc) as integer) as red_flag_rank
from screener group by ticker"""))
def _(x: Inputs) -> DataFrame:
    return screen.flag_rank(x.screener)


@register("yearly_flag_change", after("screener", sql="""
with_rates as (
  select period_fiscal_year, avg(if(red_flag_count > 0, 1, 0)) as rate from screener group by 1)
select a.period_fiscal_year, round(a.rate, 6) as red_flag_rate, round(b.rate, 6) as previous_rate,
  round(a.rate - b.rate, 6) as change
from with_rates a left join with_rates b on b.period_fiscal_year = a.period_fiscal_year - 1
""").replace("\nwith_rates as", ",\nwith_rates as", 1))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.yearly_change(x.screener), "red_flag_rate", "previous_rate", "change")


def _histogram_sql(column: str, bins: int, low: float, high: float) -> str:
    return after("screener", sql=f""",
vals as (
  select cast({column} as double) as v, row_number() over (order by {column}) - 1 as pos,
    cast(count(*) over () as double) as n from screener where {column} is not null),
ends as (
  select max(if(pos = floor(n * cast({low} as double)), v, null)) as low,
    max(if(pos = ceil(n * cast({high} as double)) - 1, v, null)) as high from vals),
placed as (
  select cast(least({bins - 1}, greatest(0, floor((v - low)
      / if(high = low, 1, high - low) * {bins}))) as integer) as bin,
    v < low or v > high as outside from vals, ends)
select cast(b.range as integer) as bin, count(p.bin) as n,
  count(*) filter (where outside) as n_clipped, any_value(low) as low, any_value(high) as high
from range({bins}) b left join placed p on p.bin = b.range, ends group by b.range""")


@register("histogram_m_score", _histogram_sql("m_score", 20, 0.05, 0.95))
def _(x: Inputs) -> DataFrame:
    return screen.histogram(x.screener, "m_score")


@register("histogram_z_score", _histogram_sql("z_score", 20, 0.05, 0.95))
def _(x: Inputs) -> DataFrame:
    return screen.histogram(x.screener, "z_score")


@register("histogram_f_score", _histogram_sql("f_score", 10, 0.0, 1.0))
def _(x: Inputs) -> DataFrame:
    return screen.histogram(x.screener, "f_score", fixed.F_SCORE_BINS, (0.0, 1.0))


@register("leading_digits", after("staged", sql="""
, digits as (
  select cast(regexp_extract(cast(value as varchar), '[1-9]') as integer) as digit,
    count(*) as n from staged where value <> 0 group by 1)
select digit, n, round(n / sum(n) over (), 6) as share,
  round(log10(1 + 1 / digit), 6) as expected_share,
  round(pow(n - sum(n) over () * log10(1 + 1 / digit), 2)
    / (sum(n) over () * log10(1 + 1 / digit)), 6) as chi_square_term from digits"""))
def _(x: Inputs) -> DataFrame:
    return rounded(screen.leading_digits(x.staged), "share", "expected_share", "chi_square_term")


_LEAD = "cast(date_diff('day', as_of_date, public_event_date) as double) / 365.25"


@register("case_study_spotlight", after("screener", sql=f"""
select s.ticker, company_name, period_fiscal_year, m_score, z_score, f_score, red_flag_count,
  case_study_note, as_of_date, public_event_date, {_LEAD} as lead_time_years,
  format('{{:.1f}} years before it became public', {_LEAD}) as lead_time_label,
  company_name || ' (' || s.ticker || ') — flagged ' || strftime(as_of_date, '%b %-d, %Y')
    || ', ' || lead_time_label as title,
  cast(red_flag_count > 0 as integer) as is_flagged_year
from screener s left join events e on e.ticker = s.ticker and event_label = 'pre_disclosure'
where is_case_study"""))
def _(x: Inputs) -> DataFrame:
    return screen.spotlight(x.screener, x.events)


@register("drill_through", after("screener", sql=f"""
select entity_id || '-' || period_fiscal_year as detail_key, red_flag_count,
  if(coalesce(aqi > 1.5, false), 'Elevated', 'Normal') as aqi_level,
  if(coalesce(tata > 0.05, false), 'Elevated', 'Normal') as tata_level,
  {' + '.join('d.' + c for c in scoring.SIGNAL_COLUMNS)} as signals_passed,
  s.company_name || ' — FY' || period_fiscal_year as title
from screener s join scored d using (entity_id, period_fiscal_year)"""))
def _(x: Inputs) -> DataFrame:
    return screen.drill_through(x.screener, scoring.score_detail(x.scored))


@register("selected_value", after("screener", sql="""
select if(count(distinct ticker) = 1, max(ticker), 'several') as ticker from screener"""))
def _(x: Inputs) -> DataFrame:
    return screen.selected_value(x.screener, "ticker", "several")


# -- backtest --------------------------------------------------------------------------------

_PANEL_COLUMNS = (
    "event_ticker, event_label, as_of_date, public_event_date, event_description, entity_id, "
    "ticker, company_name, form, period_end, period_fiscal_year, revenue, cogs, "
    "gross_profit_reported, receivables, current_assets, total_assets, ppe_net, "
    "depreciation_amortisation, sga, current_liabilities, long_term_debt, "
    "total_liabilities_reported, net_income, cfo, retained_earnings, operating_income, "
    "shares_current_basis, gross_profit, total_liabilities")
_ASOF_COLUMNS = ("event_ticker, event_label, as_of_date, public_event_date, ticker, "
                 "company_name, period_fiscal_year, m_score, z_score, f_score")


@register("financials_as_of", after("asof_years", sql=f"select {_PANEL_COLUMNS} from years_asof"))
def _(x: Inputs) -> DataFrame:
    return backtest.panel(backtest.visible_years(x.pit, x.events))


@register("scores_as_of", after("asof", sql=f"select {_ASOF_COLUMNS} from scored_asof"))
def _(x: Inputs) -> DataFrame:
    return backtest.scores_as_of(x.visible_years, x.prices)


@register("scores_as_of_current_shares", after("asof", sql=f"""
select {_ASOF_COLUMNS} from scored_asof""").replace(
    "a.shares <= b.shares as", "a.shares_current_basis <= b.shares_current_basis as"))
def _(x: Inputs) -> DataFrame:
    return backtest.scores_as_of(x.visible_years, x.prices, "shares_current_basis")


@register("strict_financials_as_of",
          after("strict_years", sql=f"select {_PANEL_COLUMNS} from years_strict"))
def _(x: Inputs) -> DataFrame:
    return backtest.panel(x.build_strict_years())


@register("knowledge_intervals", after("pit", sql="""
, days as (select distinct entity_id, concept, period_end, period_fiscal_year, filed_date as known_from
  from pit),
states as (
  select d.*, arg_max(source_tag, (p.filed_date, coalesce(accession, ''))) as latest_tag,
    count(distinct source_tag) as n_distinct_tags, bool_or(form in ('20-F', '20-F/A')) as is_foreign
  from days d join pit p using (entity_id, concept, period_end)
  where p.filed_date <= known_from group by all),
lines as (
  select s.entity_id, s.concept, s.period_end, known_from, count(*) as n_reports,
    arg_min(p.value, (p.filed_date, coalesce(accession, '~'))) as value,
    arg_min(p.form, (p.filed_date, coalesce(accession, '~'))) as form,
    arg_min(accession is not null, (p.filed_date, coalesce(accession, '~'))) as is_supported,
    arg_max(p.value, (p.filed_date, coalesce(accession, '~'))) as latest_reported_value,
    min(p.filed_date) as first_filed_date
  from states s join pit p on p.entity_id = s.entity_id and p.concept = s.concept
    and p.period_end = s.period_end and p.source_tag = s.latest_tag and p.filed_date <= known_from
  group by all)
select entity_id, concept, period_end, known_from,
  lead(known_from) over (partition by entity_id, concept, period_end order by known_from) as known_to,
  period_fiscal_year, latest_tag, n_distinct_tags, n_reports, form, value, first_filed_date,
  latest_reported_value, is_supported, is_foreign
from states join lines using (entity_id, concept, period_end, known_from)"""))
def _(x: Inputs) -> DataFrame:
    return knowledge.knowledge_intervals(x.pit).drop("ticker", "company_name")


@register("known_on_a_date", after("pit", sql="""
select entity_id, period_fiscal_year, count(distinct (concept, period_end)) as n_figures
from pit where filed_date <= date '2014-06-30' group by all"""))
def _(x: Inputs) -> DataFrame:
    intervals = x.knowledge
    day = F.lit("2014-06-30").cast("date")
    return intervals.filter(knowledge.known_on(intervals, day)).groupBy(
        "entity_id", "period_fiscal_year").agg(F.count(F.lit(1)).alias("n_figures"))


@register("strict_scores_as_of",
          after("strict", sql=f"select {_ASOF_COLUMNS} from scored_strict"))
def _(x: Inputs) -> DataFrame:
    return backtest.scores_as_of(x.strict_years, x.prices)


@register("hindsight_in_backtest", after("asof", "strict", sql="""
select a.event_label, count(*) as company_years,
  count(*) filter (where a.m_score is distinct from s.m_score) as m_differs,
  count(*) filter (where a.z_score is distinct from s.z_score) as z_differs,
  count(*) filter (where a.f_score is distinct from s.f_score) as f_differs
from scored_asof a join scored_strict s using (event_ticker, event_label, period_fiscal_year)
group by 1"""))
def _(x: Inputs) -> DataFrame:
    key = ["event_ticker", "event_label", "period_fiscal_year"]
    loose = backtest.scores_as_of(x.visible_years, x.prices).select(
        *key, "m_score", "z_score", "f_score")
    strict = backtest.scores_as_of(x.strict_years, x.prices).select(
        *key, *[F.col(c).alias(f"_{c}") for c in ("m_score", "z_score", "f_score")])
    return loose.join(strict, key).groupBy("event_label").agg(
        F.count(F.lit(1)).alias("company_years"),
        *[F.count_if(~F.col(f"{m}_score").eqNullSafe(F.col(f"_{m}_score"))).alias(f"{m}_differs")
          for m in ("m", "z", "f")])


# -- accruals and returns --------------------------------------------------------------------

@register("accrual_returns", after("accruals", sql="""
select entity_id, ticker, period_fiscal_year, tata, first_filed_date, entry_date, entry_price,
  exit_date, exit_price, fwd_return_12m, accrual_quintile from accruals"""))
def _(x: Inputs) -> DataFrame:
    return accruals.accrual_returns(x.scored, x.prices)


_STATS = ("mean_tata", "mean_return", "median_return", "std_return")


@register("quintile_stats", after("accruals", sql=f"""
select accrual_quintile, n, {_round_sql(*_STATS)} from quintiles"""))
def _(x: Inputs) -> DataFrame:
    return rounded(accruals.quintile_stats(x.accrual_returns), *_STATS)


@register("hedge_test", after("accruals", sql="""
select round(a.mean_return - z.mean_return, 6) as hedge_return,
  round(a.median_return - z.median_return, 6) as median_hedge_return,
  round((a.mean_return - z.mean_return)
    / sqrt(a.std_return * a.std_return / a.n + z.std_return * z.std_return / z.n), 6) as t_stat,
  (select count(distinct period_fiscal_year) from accruals where accrual_quintile is not null)
    as n_years
from quintiles a, quintiles z where a.accrual_quintile = 1 and z.accrual_quintile = 5"""))
def _(x: Inputs) -> DataFrame:
    test = accruals.hedge_test(x.quintiles, x.accrual_returns).drop("p_value")
    return rounded(test, "hedge_return", "median_hedge_return", "t_stat")


_TEST_SQL = after("accruals", sql="""
, ends as (
  select a.mean_return - z.mean_return as hedge, a.median_return - z.median_return as median_hedge,
    hedge / sqrt(a.std_return * a.std_return / a.n + z.std_return * z.std_return / z.n) as t_stat,
    (select count(distinct period_fiscal_year) from accruals where accrual_quintile is not null)
      as n_years
  from quintiles a, quintiles z where a.accrual_quintile = 1 and z.accrual_quintile = 5),
test as (
  select *, if(abs(t_stat) > 8, 0, greatest(0, 1 - 2 * abs(t_stat) / 1200 / sqrt(2 * pi())
    * list_sum(list_transform(range(0, 401), lambda i:
        if(i in (0, 400), 1, if(i % 2 = 1, 4, 2)) * exp(-pow(abs(t_stat) * i / 400, 2) / 2)))
  )) as p_value from ends)
""")


@register("hedge_p_value", _TEST_SQL + "select round(t_stat, 6) as t_stat, "
          "round(p_value, 6) as p_value from test")
def _(x: Inputs) -> DataFrame:
    return rounded(accruals.hedge_test(x.quintiles, x.accrual_returns).select("t_stat", "p_value"),
                   "t_stat", "p_value")


@register("accrual_report", _TEST_SQL + """
select 1 as line_no, printf('Accruals and later returns: %d fiscal years, quintiles by TATA',
    n_years) as line from test
union all select 2, ' Q       n   mean TATA   mean return   median return       std'
union all select accrual_quintile + 2, printf('%2d  %6d  %10.4f  %11.4f%%  %13.4f%%  %8.4f',
    accrual_quintile, n, mean_tata, mean_return * 100, median_return * 100, std_return)
  from quintiles
union all select 8, printf('Hedge return, means: %.4f%%  Welch t=%.3f  p=%.4f', hedge * 100,
    t_stat, p_value) from test
union all select 9, printf('Hedge return, medians: %.4f%%', median_hedge * 100) from test""")
def _(x: Inputs) -> DataFrame:
    return accruals.report_lines(x.quintiles,
                                 accruals.hedge_test(x.quintiles, x.accrual_returns))


# -- data quality ----------------------------------------------------------------------------

@register("null_counts", after("facts", sql=" union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as n_null from facts "
    f"having count(*) > count({c})" for c in ("accession", "period_start", "value", "form"))))
def _(x: Inputs) -> DataFrame:
    return quality.null_violations(x.facts, ["accession", "period_start", "value", "form"])


_MART_SQL = {"pit": "pit", "beneish": "scored", "altman": "scored", "piotroski": "scored",
             "financials_as_of": "years_asof", "scores_as_of": "scored_asof",
             "accrual_returns": "accruals", "screener": "screener", "case_studies": "cases",
             "backtest_events": "events",
         "concepts": "(select distinct concept, true as restatement_eligible from facts)"}


@register("required_columns", after("asof", "accruals", "screener", sql=" union all ".join(
    f"select '{mart}' as mart, '{c}' as \"column\", count(*) - count({c}) as n_null "
    f"from {table}" for mart, table in _MART_SQL.items() for c in quality.REQUIRED[mart])))
def _(x: Inputs) -> DataFrame:
    return quality.required_columns({
        "pit": x.pit, "beneish": scoring.beneish(x.scored), "altman": scoring.altman(x.scored),
        "piotroski": scoring.piotroski(x.scored),
        "financials_as_of": backtest.panel(x.visible_years),
        "scores_as_of": backtest.scores_as_of(x.visible_years, x.prices),
        "accrual_returns": x.accrual_returns, "screener": x.screener,
        "case_studies": x.case_studies, "backtest_events": x.events,
        "concepts": staging.concept_table(x.spark)})


@register("pit_by_fiscal_year", after("pit", sql="""
select concept, count(*) as n, count(*) filter (where is_first_report) as n_first from pit
where period_fiscal_year = 2013 group by 1"""))
def _(x: Inputs) -> DataFrame:
    """Written by fiscal year and read back with a year filter, which prunes directories."""
    path = fresh_path(x.spark, "pit")
    writers.write_pit(x.pit, path)
    kept = x.spark.read.schema(x.pit.schema).parquet(path).filter("period_fiscal_year = 2013")
    return kept.groupBy("concept").agg(F.count(F.lit(1)).alias("n"),
                                       F.count_if("is_first_report").alias("n_first"))


@register("repeated_facts", after("facts", sql="""
select entity_id, concept, source_tag, unit, period_end, accession, count(*) as n from facts
group by all having count(*) > 1"""))
def _(x: Inputs) -> DataFrame:
    return quality.repeated(x.facts, ["entity_id", "concept", "source_tag", "unit", "period_end",
                                      "accession"])


@register("unmodelled_units", after("facts", sql=f"""
select {FACT_COLUMNS} from facts where unit not in ('USD', 'shares')"""))
def _(x: Inputs) -> DataFrame:
    return quality.outside_values(x.facts, "unit", list(fixed.UNITS))


@register("negative_magnitudes", after("staged", sql=f"""
select {_STAGED_SQL} from staged where sign_convention = 'always_positive' and value < 0"""))
def _(x: Inputs) -> DataFrame:
    return quality.negative_magnitudes(x.staged)


@register("repeated_first_reports", after("pit", sql="""
select entity_id, concept, period_fiscal_year, count(*) as n from pit where is_first_report
group by all having count(*) > 1"""))
def _(x: Inputs) -> DataFrame:
    return quality.repeated_first_reports(x.pit)


@register("rival_period_ends", after("pit", sql="""
select entity_id, period_fiscal_year, count(distinct period_end) as n_period_ends,
  count(distinct if(is_first_report, period_end, null)) as n_canonical
from pit group by all having count(distinct period_end) > 1"""))
def _(x: Inputs) -> DataFrame:
    """Changed fiscal year ends: several period ends in the table, one of them canonical."""
    return x.pit.groupBy("entity_id", "period_fiscal_year").agg(
        F.countDistinct("period_end").alias("n_period_ends"),
        F.countDistinct(F.when(F.col("is_first_report"), F.col("period_end")))
        .alias("n_canonical")).filter("n_period_ends > 1")


@register("unanchored_instants", after("pit", sql=f"""
select {_PIT_SQL} from pit p where period_start is null and not exists (
  select 1 from staged s where s.entity_id = p.entity_id and s.accession = p.accession
    and s.period_end = p.period_end and s.period_type = 'annual'
    and s.form in ('10-K', '10-K/A', '20-F', '20-F/A'))"""))
def _(x: Inputs) -> DataFrame:
    return quality.unanchored_instants(x.pit, x.staged)


@register("dropped_snapshots", after("pit", sql="""
select s.entity_id, s.concept, s.period_end, count(*) as n from staged s
where period_type = 'instant' and not exists (
  select 1 from pit p where p.entity_id = s.entity_id and p.concept = s.concept
    and p.period_end = s.period_end) group by all"""))
def _(x: Inputs) -> DataFrame:
    """Snapshots between year ends that anchoring kept out of the table."""
    on = ["entity_id", "concept", "period_end"]
    return x.staged.filter("period_type = 'instant'").join(
        x.pit.select(*on).distinct(), on, "left_anti").groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"))


@register("large_lineage_moves", after("pit", sql=f"""
select {_PIT_SQL} from pit where concept = 'shares_diluted' and in_lineage
  and abs(restatement_pct) > 1"""))
def _(x: Inputs) -> DataFrame:
    return quality.large_lineage_moves(x.pit, "shares_diluted")


@register("wrong_component_sums", after("pit", sql=f"""
, expected as (
  select entity_id, accession, period_end, sum(v) as total from (
    select distinct entity_id, accession, period_end, source_tag, value as v from staged
    where concept = 'cogs') group by all)
select {', '.join('p.' + c for c in bitemporal.PIT_COLUMNS)} from pit p
join expected e using (entity_id, accession, period_end)
where is_first_report and concept = 'cogs'
  and (source_tag not like '%+%' or abs(value - total) > 1)"""))
def _(x: Inputs) -> DataFrame:
    return quality.wrong_component_sum(x.pit, _component_totals(x), 1.0).select(
        *bitemporal.PIT_COLUMNS)


def _component_totals(x: Inputs) -> DataFrame:
    parts = x.staged.filter("concept = 'cogs' and period_type = 'annual'").select(
        "ticker", "concept", "period_fiscal_year", "accession", "source_tag", "value").distinct()
    return parts.groupBy("ticker", "concept", "period_fiscal_year", "accession").agg(
        F.sum("value").alias("v")).groupBy("ticker", "concept", "period_fiscal_year").agg(
        F.max("v").alias("expected_value"))


@register("totals_beside_components", after("staged", sql="""
select entity_id, concept, period_end, accession,
  count(*) filter (where source_tag in ('CostOfGoodsAndServicesSold', 'CostOfRevenue')) as totals,
  count(*) filter (where source_tag not in ('CostOfGoodsAndServicesSold', 'CostOfRevenue'))
    as components
from staged where combine_mode = 'sum' and period_type = 'annual' group by all
having totals > 0 and components > 0"""))
def _(x: Inputs) -> DataFrame:
    return quality.totals_beside_components(x.staged)


@register("priced_foreign_filers", after("scored", sql=f"""
select {_WHO}, period_fiscal_year, market_value_of_equity, z_score from scored
join abroad using (entity_id) where market_value_of_equity is not null or z_score is not null"""))
def _(x: Inputs) -> DataFrame:
    return quality.priced_foreign_filers(scoring.altman(x.scored), x.pit).select(
        "entity_id", "ticker", "company_name", "period_fiscal_year", "market_value_of_equity",
        "z_score")


def _implausible(column: str) -> tuple[Build, str]:
    low, high = fixed.PLAUSIBLE[column]
    part = "accruals" if column == "fwd_return_12m" else "scored"
    sql = after(part, sql=f"select entity_id, period_fiscal_year, {column} from {part} "
                          f"where {column} < {low} or {column} > {high}")

    def build(x: Inputs) -> DataFrame:
        table = x.accrual_returns if part == "accruals" else x.scored
        return quality.outside_range(table, column).select(
            "entity_id", "period_fiscal_year", column)
    return build, sql


for _column in fixed.PLAUSIBLE:
    REGISTRY[f"implausible_{_column}"] = _implausible(_column)


@register("inconsistent_flag_counts", after("screener", sql=f"""
select {_SCREENER_SQL} from screener where red_flag_count > models_scored
  or red_flag_count < 0 or models_scored > 3"""))
def _(x: Inputs) -> DataFrame:
    return quality.inconsistent_flag_counts(x.screener)


@register("unreconciled_scores", after("asof", "scored", sql="""
select ticker, period_fiscal_year, a.m_score as asof_m, a.z_score as asof_z,
  a.f_score as asof_f, p.m_score as prod_m, p.z_score as prod_z, p.f_score as prod_f
from (select * from scored_asof where event_label = 'full_history') a
full join scored p using (ticker, period_fiscal_year)
where abs(coalesce(a.m_score, 0) - coalesce(p.m_score, 0)) > 0.001
  or abs(coalesce(a.z_score, 0) - coalesce(p.z_score, 0)) > 0.001
  or coalesce(a.f_score, -1) <> coalesce(p.f_score, -1)"""))
def _(x: Inputs) -> DataFrame:
    return quality.unreconciled(backtest.scores_as_of(x.visible_years, x.prices), x.scored)


@register("top_score_years", after("scored", sql="""
select ticker, period_fiscal_year, m_score from scored where m_score is not null
qualify row_number() over (partition by ticker order by m_score desc, period_fiscal_year desc) = 1
"""))
def _(x: Inputs) -> DataFrame:
    return quality.top_years(x.scored)


@register("unexpected_top_years", after("scored", sql="""
select ticker, period_fiscal_year, m_score from (
  select ticker, period_fiscal_year, m_score from scored where m_score is not null
  qualify row_number() over (partition by ticker
    order by m_score desc, period_fiscal_year desc) = 1)
where period_fiscal_year <> 2013"""))
def _(x: Inputs) -> DataFrame:
    expected = x.companies.select("ticker", F.lit(2013).alias("period_fiscal_year"))
    return quality.unexpected_top_year(x.scored, expected)


@register("heavy_company_keys", after("facts", sql="""
select entity_id from facts group by 1
having count(*) > (select count(*) // count(distinct entity_id) from facts)"""))
def _(x: Inputs) -> DataFrame:
    mean = x.facts.count() // max(1, x.companies.count())
    found = volume.heavy_keys(x.facts, ["entity_id"], mean)
    return x.facts.select("entity_id").limit(0) if found is None else found


@register("quality_summary", after("scored", "screener", "pit", sql="""
select 'facts without entity' as "check", count(*) as violations from facts where entity_id is null
union all select 'negative magnitudes', count(*) from staged
  where sign_convention = 'always_positive' and value < 0
union all select 'repeated first reports', count(*) from (
  select 1 from pit where is_first_report group by entity_id, concept, period_fiscal_year
  having count(*) > 1)
union all select 'unanchored instants', count(*) from pit p where period_start is null and not exists (
  select 1 from staged s where s.entity_id = p.entity_id and s.accession = p.accession
    and s.period_end = p.period_end and s.period_type = 'annual'
    and s.form in ('10-K', '10-K/A', '20-F', '20-F/A'))
union all select 'priced foreign filers', count(*) from scored join abroad using (entity_id)
  where market_value_of_equity is not null or z_score is not null
""" + "".join(f"union all select '{name}', count(*) from scored where {c} < {low} or {c} > {high}\n"
              for name, c, (low, high) in (("implausible M", "m_score", fixed.PLAUSIBLE["m_score"]),
                                           ("implausible Z", "z_score", fixed.PLAUSIBLE["z_score"])))
    + """union all select 'inconsistent flag counts', count(*) from screener
  where red_flag_count > models_scored or red_flag_count < 0 or models_scored > 3"""))
def _(x: Inputs) -> DataFrame:
    """Violations per check, one row each."""
    checks = {
        "facts without entity": x.facts.filter("entity_id is null"),
        "negative magnitudes": quality.negative_magnitudes(x.staged),
        "repeated first reports": quality.repeated_first_reports(x.pit),
        "unanchored instants": quality.unanchored_instants(x.pit, x.staged),
        "priced foreign filers": quality.priced_foreign_filers(scoring.altman(x.scored), x.pit),
        "implausible M": quality.outside_range(x.scored, "m_score"),
        "implausible Z": quality.outside_range(x.scored, "z_score"),
        "inconsistent flag counts": quality.inconsistent_flag_counts(x.screener),
    }
    counted = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
               for name, df in checks.items()]
    total = counted[0]
    for df in counted[1:]:
        total = total.union(df)
    return total


_ON_WRITE = {
    "staged": ("staged", {"negative magnitudes": "sign_convention = 'always_positive' and value < 0"}),
    "beneish": ("scored", {"implausible m_score": "m_score < {} or m_score > {}".format(*fixed.PLAUSIBLE["m_score"])}),
    "altman": ("scored", {"implausible z_score": "z_score < {} or z_score > {}".format(*fixed.PLAUSIBLE["z_score"])}),
    "accrual_returns": ("accruals", {"implausible fwd_return_12m": "fwd_return_12m < {} or fwd_return_12m > {}".format(
        *fixed.PLAUSIBLE["fwd_return_12m"])}),
    "screener": ("screener", {"inconsistent flag counts":
                              "red_flag_count not between 0 and 3 or models_scored not between 0 and 3 "
                              "or red_flag_count > models_scored"}),
    "pit": ("pit", {}),
}


def _on_write_sql() -> str:
    parts = []
    for mart, (table, conditions) in _ON_WRITE.items():
        every = {"rows": "true"} | {f"null {c}": f"{c} is null" for c in quality.REQUIRED.get(mart, ())}
        parts += [f"select '{mart}' as mart, '{check}' as \"check\", "
                  f"count(*) filter (where {condition}) as violations from {table}"
                  for check, condition in (every | conditions).items()]
    return " union all ".join(parts)


@register("quality_on_write", after("pit", "accruals", "screener", sql=_on_write_sql()))
def _(x: Inputs) -> DataFrame:
    """Checks on single rows, observed while the marts are written."""
    marts = {"staged": x.staged, "beneish": scoring.beneish(x.scored), "altman": scoring.altman(x.scored),
             "accrual_returns": x.accrual_returns, "screener": x.screener, "pit": x.pit}
    found = {mart: observed.write_checked(df, mart)[1] for mart, df in marts.items()}
    return observed.violations(found, x.pit)


# -- the same checks on inputs with planted violations -----------------------------------------

@register("planted_negative_magnitudes", after("staged", sql=f"""
select {_STAGED_SQL} from (select * replace (-abs(value) - 1 as value) from staged
  where period_fiscal_year = 2012) where sign_convention = 'always_positive' and value < 0"""))
def _(x: Inputs) -> DataFrame:
    bad = x.staged.filter("period_fiscal_year = 2012").withColumn("value", F.expr("-abs(value) - 1"))
    return quality.negative_magnitudes(
        x.staged.filter("period_fiscal_year <> 2012").unionByName(bad))


@register("planted_repeated_first_reports", after("pit", sql="""
select entity_id, concept, period_fiscal_year, 2 * count(*) as n from pit
where is_first_report and period_fiscal_year = 2013 group by all"""))
def _(x: Inputs) -> DataFrame:
    return quality.repeated_first_reports(
        x.pit.union(x.pit.filter("period_fiscal_year = 2013")))


@register("planted_unanchored_instants", after("pit", sql=f"""
select {_PIT_SQL} from pit where period_start is null and period_fiscal_year = 2012"""))
def _(x: Inputs) -> DataFrame:
    """Without the annual rows of one fiscal year its balance-sheet rows stand unanchored."""
    return quality.unanchored_instants(x.pit, x.staged.filter(
        "not (period_type = 'annual' and period_fiscal_year = 2012)"))


@register("planted_wrong_component_sums", after("pit", sql=f"""
, parts as (
  select distinct ticker, period_fiscal_year, accession, source_tag, value as v from staged
  where concept = 'cogs' and period_type = 'annual'),
expected as (
  select ticker, period_fiscal_year, if(period_fiscal_year % 2 = 0, v + 2, v) as total
  from (select ticker, period_fiscal_year, max(v) as v
        from (select ticker, period_fiscal_year, accession, sum(v) as v from parts group by all)
        group by all))
select {', '.join('p.' + c for c in bitemporal.PIT_COLUMNS)} from pit p
join expected e using (ticker, period_fiscal_year)
where is_first_report and concept = 'cogs'
  and (source_tag not like '%+%' or abs(value - total) > 1)"""))
def _(x: Inputs) -> DataFrame:
    """Sums of every second year are expected to be two units larger than they are."""
    moved = _component_totals(x).withColumn("expected_value", F.col("expected_value") + F.when(
        F.col("period_fiscal_year") % 2 == 0, 2).otherwise(0))
    return quality.wrong_component_sum(x.pit, moved, 1.0).select(*bitemporal.PIT_COLUMNS)


@register("planted_totals_beside_components", after("staged", sql="""
select entity_id, concept, period_end, accession, count(*) as totals, count(*) as components
from staged where combine_mode = 'sum' and period_type = 'annual' and period_fiscal_year = 2014
group by all"""))
def _(x: Inputs) -> DataFrame:
    """A total is told beside every component of one fiscal year."""
    only = x.staged.filter("combine_mode = 'sum' and period_fiscal_year = 2014").filter(
        ~F.col("source_tag").isin("CostOfGoodsAndServicesSold", "CostOfRevenue"))
    return quality.totals_beside_components(
        only.unionByName(only.withColumn("source_tag", F.lit("CostOfRevenue"))))


@register("planted_priced_foreign_filers", after("scored", sql="""
select entity_id, period_fiscal_year, 1.0 as market_value_of_equity from scored
join abroad using (entity_id)"""))
def _(x: Inputs) -> DataFrame:
    priced = scoring.altman(x.scored).withColumn("market_value_of_equity", F.lit(1.0))
    return quality.priced_foreign_filers(priced, x.pit).select(
        "entity_id", "period_fiscal_year", "market_value_of_equity")


def _planted_implausible(column: str) -> tuple[Build, str]:
    low, high = fixed.PLAUSIBLE[column]
    part = "accruals" if column == "fwd_return_12m" else "scored"
    sql = after(part, sql=f"select entity_id, period_fiscal_year, {column} * 1000 as {column} "
                          f"from {part} where {column} * 1000 < {low} or {column} * 1000 > {high}")

    def build(x: Inputs) -> DataFrame:
        table = x.accrual_returns if part == "accruals" else x.scored
        return quality.outside_range(table.withColumn(column, F.col(column) * 1000), column).select(
            "entity_id", "period_fiscal_year", column)
    return build, sql


for _column in fixed.PLAUSIBLE:
    REGISTRY[f"planted_implausible_{_column}"] = _planted_implausible(_column)


@register("planted_inconsistent_flag_counts", after("screener", sql="""
select entity_id, period_fiscal_year, red_flag_count, 0 as models_scored from screener
where red_flag_count > 0"""))
def _(x: Inputs) -> DataFrame:
    return quality.inconsistent_flag_counts(x.screener.withColumn("models_scored", F.lit(0))).select(
        "entity_id", "period_fiscal_year", "red_flag_count", "models_scored")


@register("planted_unreconciled_scores", after("asof", "scored", sql="""
select ticker, period_fiscal_year, a.f_score as asof_f, p.f_score + 1 as prod_f
from (select * from scored_asof where event_label = 'full_history') a
join scored p using (ticker, period_fiscal_year) where p.f_score is not null"""))
def _(x: Inputs) -> DataFrame:
    shifted = x.scored.withColumn("f_score", F.col("f_score") + 1)
    return quality.unreconciled(backtest.scores_as_of(x.visible_years, x.prices), shifted).select(
        "ticker", "period_fiscal_year", "asof_f", "prod_f")


@register("planted_seed_violations", after("facts", sql="""
select 'concept' as key, concept as value, 2 as n from (select distinct concept from facts)
union all select 'ticker', ticker, 2 from cases
union all select 'sign_convention', 'odd', count(distinct concept) from facts"""))
def _(x: Inputs) -> DataFrame:
    """Unique keys and accepted values of the seed tables, each row of which is planted twice."""
    concepts = staging.concept_table(x.spark).join(
        x.facts.select("concept").distinct(), "concept", "left_semi")
    twice = quality.repeated(concepts.union(concepts), ["concept"]).select(
        F.lit("concept").alias("key"), F.col("concept").alias("value"), "n")
    cases = quality.repeated(x.case_studies.union(x.case_studies), ["ticker"]).select(
        F.lit("ticker"), "ticker", "n")
    odd = quality.outside_values(concepts.withColumn("sign_convention", F.lit("odd")),
                                 "sign_convention", ["any", "always_positive"])
    counted = odd.groupBy("sign_convention").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("sign_convention"), "sign_convention", "n")
    return twice.union(cases).union(counted)
