"""Sinks. Facts are laid out by concept, so reading one concept reads one directory."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed, schemas
from ..durable import write_partitioned
from ..operators.staging import concept_table


def write_facts(facts: DataFrame, companies: DataFrame, path: str,
                partition_by: tuple[str, ...] = ("concept",)) -> None:
    """Attach names and write the fact table. ``companies`` must be unique per entity."""
    labelled = facts.join(companies, "entity_id").select(*schemas.FACTS.names)
    write_partitioned(labelled, path, partition_by)


def write_prices(prices: DataFrame, path: str) -> None:
    prices.select(*schemas.PRICES.names).write.parquet(path)


def write_pit(pit: DataFrame, path: str) -> None:
    """The bitemporal table by fiscal year, so that year filters prune directories."""
    write_partitioned(pit, path, ("period_fiscal_year",))


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def detail_key() -> F.Column:
    return F.concat_ws("-", "entity_id", "period_fiscal_year").alias("detail_key")


def write_screener(screener: DataFrame, path: str) -> None:
    _csv(screener.select("*", detail_key()), path)


def write_score_detail(detail: DataFrame, path: str) -> None:
    _csv(detail, path)


def write_constituents(table: DataFrame, path: str) -> None:
    _csv(table, path)


# -- seeds -----------------------------------------------------------------------------------

def case_study_table(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(schemas.CASE_STUDIES.names, row)) for row in fixed.CASE_STUDIES]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def event_table(spark: SparkSession) -> DataFrame:
    """Two events per listed company: shortly before disclosure, and the whole history."""
    dated = [
        {"ticker": t, "event_label": "pre_disclosure", "as_of_date": known,
         "public_event_date": public,
         "event_description": f"Last look before the matter became public on {public}"}
        for t, known, public in fixed.PRE_DISCLOSURE_DATES
    ] + [
        {"ticker": t, "event_label": "full_history", "as_of_date": fixed.FULL_HISTORY_DATE,
         "public_event_date": fixed.FULL_HISTORY_DATE,
         "event_description": "Control: every filing visible, equal to the production scores"}
        for t, _, _ in fixed.PRE_DISCLOSURE_DATES
    ]
    return spark.createDataFrame(pa.Table.from_pylist(dated)).withColumns(
        {c: F.to_date(c) for c in ("as_of_date", "public_event_date")})


def write_seeds(spark: SparkSession, folder: str) -> None:
    _csv(concept_table(spark), f"{folder}/concepts")
    _csv(case_study_table(spark), f"{folder}/case_studies")
    _csv(event_table(spark), f"{folder}/backtest_events")
