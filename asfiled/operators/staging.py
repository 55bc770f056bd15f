"""Cleaning of reported facts, prices and the sector table. Narrow transformations only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import filing_lag, fiscal_year_of, period_class, period_length

_META = ("concept", "kind", "statement", "required", "sign_convention",
         "restatement_eligible", "combine")


def concept_table(spark: SparkSession) -> DataFrame:
    """The concept metadata as a local relation: one row per entry of the fixed table."""
    rows = [dict(zip(_META, c[:7])) for c in fixed.CONCEPTS]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def tag_table(spark: SparkSession, concepts: tuple[fixed.Concept, ...] = fixed.CONCEPTS) -> DataFrame:
    """(source_tag, concept, tag_priority); a tag listed twice keeps its first definition."""
    listed = pa.Table.from_pylist(
        [{"_nth": i, "concept": c.concept, "tags": list(c.tags)} for i, c in enumerate(concepts)])
    each = spark.createDataFrame(listed).select(
        "_nth", "concept", F.posexplode("tags").alias("tag_priority", "source_tag"))
    first = F.min(F.struct("_nth", "tag_priority", "concept")).alias("_first")
    return each.groupBy("source_tag").agg(first).select(
        "source_tag", "_first.concept", "_first.tag_priority")


def stage_facts(facts: DataFrame, concepts: DataFrame | None = None,
                min_fiscal_year: int = fixed.MIN_FISCAL_YEAR,
                min_filing_lag_days: int = fixed.MIN_FILING_LAG_DAYS) -> DataFrame:
    """Typed, classified and sign-normalised facts.

    ``concepts`` replaces the built-in metadata; being the caller's table it is joined without a
    hint, so Spark picks the strategy from its measured size. The built-in one is 23 rows.
    """
    meta = F.broadcast(concept_table(facts.sparkSession)) if concepts is None else concepts
    meta = meta.select("concept", "sign_convention", "restatement_eligible", "combine")

    typed = facts.select(
        "entity_id", "ticker", "company_name", "concept", "source_tag", "tag_priority", "unit",
        F.col("period_start").cast("date"), F.col("period_end").cast("date"),
        F.col("filed_date").cast("date"), "form", "accession",
        F.col("value").cast("double").alias("reported"),
    ).filter("reported is not null and period_end is not null and filed_date is not null")

    dated = typed.withColumns({
        "period_fiscal_year": fiscal_year_of(F.col("period_end")),
        "period_days": period_length(F.col("period_start"), F.col("period_end")),
        "filing_lag_days": filing_lag(F.col("period_end"), F.col("filed_date")),
    }).filter((F.col("period_fiscal_year") >= min_fiscal_year)
              & (F.col("filing_lag_days") >= min_filing_lag_days))

    known = dated.join(meta, "concept", "left")
    convention = F.coalesce("sign_convention", F.lit("any"))
    slipped = (convention == "always_positive") & (F.col("reported") < 0)
    return known.select(
        "entity_id", "ticker", "company_name", "concept", "source_tag", "tag_priority", "unit",
        "period_start", "period_end", "filed_date", "form", "accession", "period_fiscal_year",
        "period_days", period_class(F.col("period_days")).alias("period_type"),
        "filing_lag_days",
        F.coalesce("restatement_eligible", F.lit(True)).alias("restatement_eligible"),
        F.coalesce("combine", F.lit("best")).alias("combine_mode"),
        convention.alias("sign_convention"),
        F.when(slipped, F.abs("reported")).otherwise(F.col("reported")).alias("value"),
        slipped.alias("sign_was_negative"))


def stage_prices(prices: DataFrame) -> DataFrame:
    return prices.filter(F.col("close").isNotNull()).select(
        "ticker", F.col("date").cast("date").alias("price_date"), F.col("close").cast("double"))


def stage_sectors(sectors: DataFrame) -> DataFrame:
    return sectors.select(F.upper("ticker").alias("ticker"), "gics_sector")
