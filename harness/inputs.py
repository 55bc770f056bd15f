"""Spark side of the adapter, and per-session written tables shared by the queries."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asfiled.durable import materialise
from asfiled.operators.bitemporal import financials_pit
from asfiled.operators.knowledge import knowledge_intervals, unsettled_companies
from asfiled.operators.staging import stage_facts, stage_prices, stage_sectors
from asfiled.plans import accruals, backtest, scoring
from asfiled.plans import screener as screen

from . import rules


def _sql(text: str) -> F.Column:
    return F.expr(text.replace("//", "div"))


def build_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filings. One aggregate over lineitem; everything after it is narrow."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    base = item.groupBy(
        F.col("l_suppkey").alias("s"), (F.year("l_shipdate") + 15).alias("y")
    ).agg(F.sum(F.floor(F.col("l_extendedprice") * 100)).alias("r"),
          F.sum(F.floor(F.col("l_extendedprice") * F.col("l_discount") * 100)).alias("d"),
          F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))
    told = base.withColumn("v", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), 2016 - F.col("y")))))
    filing = told.withColumns({
        "accession": F.concat(F.lit("A"), "s", F.lit("-"), F.col("y") + F.col("v")),
        "form": F.when(F.col("s") % 19 == 0, "20-F").otherwise("10-K"),
    })
    rows = _sql("array_compact(array(" + ", ".join(
        f"case when {r.when} then named_struct('concept', '{r.concept}', 'source_tag', "
        f"'{r.tag}', 'tag_priority', {r.priority}, 'unit', '{r.unit}', 'period_start', "
        f"{r.start}, 'period_end', {r.end}, 'form', cast({r.form} as string), 'accession', "
        f"cast({r.accession} as string), 'value', cast({r.amount} as double)) end"
        for r in rules.RULES) + "))")
    # Few narrow rows become many wide ones here, so spread them first.
    filing = filing.repartition(spark.sparkContext.defaultParallelism, "s", "y", "v")
    named = filing.join(supplier, F.col("s") == F.col("s_suppkey")).select(
        "s", F.lpad(F.col("s").cast("string"), 10, "0").alias("entity_id"),
        F.concat(F.lit("T"), "s").alias("ticker"), F.col("s_name").alias("company_name"),
        (F.col("y") + F.col("v")).cast("int").alias("fiscal_year"),
        _sql(rules.FILED).alias("filed_date"), F.explode(rows).alias("f"))
    return named.select(
        "entity_id", "ticker", "company_name", "f.concept", "f.source_tag", "f.tag_priority",
        "f.unit", "f.period_start", "f.period_end", "fiscal_year",
        F.lit("FY").alias("fiscal_period"), "f.form", "filed_date", "f.accession",
        F.lit(None).cast("string").alias("frame"), "f.value")


def build_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = item.select(F.col("l_suppkey").alias("s"),
                       F.col("l_shipdate").cast("date").alias("day")).distinct()
    return days.withColumn("k", F.datediff("day", F.lit("1970-01-01").cast("date"))).select(
        F.concat(F.lit("T"), "s").alias("ticker"), F.add_months("day", 180).alias("date"),
        _sql(rules.CLOSE).alias("close"))


class Inputs:
    """Adapter tables of one data folder. Marts are written once per session, like the tables
    a nightly build leaves for its readers; every figure still comes from the whole tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def facts(self) -> DataFrame:
        return materialise(build_facts(self.spark, self.sf_dir), "facts", ("concept",))

    @cached_property
    def raw_prices(self) -> DataFrame:
        return materialise(build_prices(self.spark, self.sf_dir), "prices")

    @property
    def prices(self) -> DataFrame:
        return stage_prices(self.raw_prices)

    @property
    def companies(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("s"),
            F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("entity_id"),
            F.concat(F.lit("T"), "s_suppkey").alias("ticker"),
            F.col("s_name").alias("company_name"), "s_nationkey")

    @property
    def sectors(self) -> DataFrame:
        nation = self.table("nation")
        placed = self.companies.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        return placed.select(
            "ticker", "company_name",
            F.when(~_sql(rules.NO_SECTOR), F.col("n_name")).alias("gics_sector"))

    @property
    def case_studies(self) -> DataFrame:
        return self.companies.filter(_sql(rules.CASE_STUDY)).select(
            "ticker", F.concat(F.lit("Case, no. "), "s").alias("case_study_note"))

    @property
    def events(self) -> DataFrame:
        def event(label: str, known: F.Column, public: F.Column, text: str) -> F.Column:
            return F.struct(F.lit(label).alias("event_label"), known.alias("as_of_date"),
                            public.alias("public_event_date"),
                            F.lit(text).alias("event_description"))

        early, late = _sql(rules.AS_OF), F.lit("2099-01-01").cast("date")
        both = F.array(event("pre_disclosure", early, F.date_add(early, 500), "before"),
                       event("full_history", late, late, "control"))
        return self.companies.select("ticker", F.explode(both).alias("e")).select("ticker", "e.*")

    @property
    def staged(self) -> DataFrame:
        return stage_facts(self.facts)

    def build_pit(self, **how) -> DataFrame:
        return financials_pit(self.staged, counted=self.facts, **how)

    @cached_property
    def pit(self) -> DataFrame:
        return materialise(self.build_pit(), "pit")

    @cached_property
    def scored(self) -> DataFrame:
        return materialise(scoring.scored_company_years(self.pit, self.prices), "scored")

    @cached_property
    def screener(self) -> DataFrame:
        return materialise(
            screen.screener(self.scored, stage_sectors(self.sectors), self.case_studies),
            "screener")

    @cached_property
    def visible_years(self) -> DataFrame:
        return materialise(backtest.visible_years(self.pit, self.events), "visible_years")

    @cached_property
    def knowledge(self) -> DataFrame:
        return materialise(knowledge_intervals(self.pit), "knowledge")

    @cached_property
    def unsettled(self) -> DataFrame:
        return materialise(unsettled_companies(self.staged), "unsettled")

    def build_strict_years(self) -> DataFrame:
        return backtest.strict_years(self.staged, self.events, intervals=self.knowledge,
                                     unsettled=self.unsettled)

    @cached_property
    def strict_years(self) -> DataFrame:
        return materialise(self.build_strict_years(), "strict_years")

    @cached_property
    def accrual_returns(self) -> DataFrame:
        return materialise(accruals.accrual_returns(self.scored, self.prices), "accruals")

    @cached_property
    def quintiles(self) -> DataFrame:
        return materialise(accruals.quintile_stats(self.accrual_returns), "quintiles")


@lru_cache(maxsize=8)
def _inputs(_application: str, spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(spark, sf_dir)


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return _inputs(spark.sparkContext.applicationId, spark, sf_dir.rstrip("/"))
