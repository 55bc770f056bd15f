"""Readers. Every schema is explicit; bad values become null instead of failing the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed, schemas
from ..operators.staging import tag_table


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FACTS).parquet(path).select(*schemas.FACTS.names)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRICES).parquet(path)


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.SECTORS)


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CONCEPTS)


def read_case_studies(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.CASE_STUDIES)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.EVENTS)


def read_screener(spark: SparkSession, path: str) -> DataFrame:
    """An exported screener CSV with its columns coerced: empty is null, True/False boolean."""
    return _csv(spark, path, T.StructType([*schemas.SCREENER, T.StructField("detail_key", T.StringType())]))


# -- nested documents ------------------------------------------------------------------------

def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, payload): one whole JSON document per file, named after its company or lying in
    a folder ``entity_id=...`` of it."""
    text = spark.read.text(path, wholetext=True)
    named = (F.col("entity_id").cast("string") if "entity_id" in text.columns
             else F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1))
    return text.select(F.lpad(named, 10, "0").alias("entity_id"),
                       F.col("value").alias("payload"))


def flatten_filings(documents: DataFrame, min_fiscal_year: int = fixed.MIN_FISCAL_YEAR) -> DataFrame:
    """(entity_id, payload) to one row per reported fact of a mapped tag.

    What can't be read gives no row here; :func:`rejected_documents` lists the documents.
    """
    spark = documents.sparkSession
    parsed = documents.select("entity_id", F.from_json("payload", schemas.FILING_DOCUMENT)
                              .getField("facts").getItem(fixed.TAXONOMY).alias("tags"))
    # A plain explode would also filter on its input, which parses every document three times; the
    # null tag of a document without any finds no concept.
    tags = parsed.select("entity_id", F.explode_outer("tags").alias("source_tag", "body"))
    mapped = tags.join(F.broadcast(tag_table(spark)), "source_tag")
    units = mapped.select("entity_id", "concept", "source_tag", "tag_priority",
                          F.explode("body.units").alias("unit", "observations"))
    each = units.select("entity_id", "concept", "source_tag", "tag_priority", "unit",
                        F.explode("observations").alias("o"))
    return each.filter(F.col("o.fy") >= min_fiscal_year).select(
        "entity_id", "concept", "source_tag", "tag_priority", "unit",
        F.col("o.start").try_cast("date").alias("period_start"),
        F.col("o.end").try_cast("date").alias("period_end"),
        F.col("o.fy").alias("fiscal_year"), F.col("o.fp").alias("fiscal_period"),
        F.col("o.form").alias("form"), F.col("o.filed").try_cast("date").alias("filed_date"),
        F.col("o.accn").alias("accession"), F.col("o.frame").alias("frame"),
        F.col("o.val").alias("value"))


def rejected_documents(documents: DataFrame) -> DataFrame:
    """(entity_id, reason) of documents that give no facts, or not all of them.

    ``empty``: no payload. ``malformed``: not such a document at all. ``partly readable``: some
    entries have another type than the schema, such as an amount told as text, or the document
    ends early; the readable facts are used. ``no facts``: nothing under the taxonomy. ``no mapped
    tags``: facts, but none of a concept.
    """
    schema = schemas.FILING_DOCUMENT.removesuffix(">") + ", _bad: string>"
    mapped = F.broadcast(tag_table(documents.sparkSession).agg(
        F.collect_set("source_tag").alias("_mapped")))
    read = documents.select("entity_id", "payload", F.from_json(
        "payload", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).join(mapped)
    tags = F.map_keys(F.col("d.facts").getItem(fixed.TAXONOMY))
    known = F.arrays_overlap(tags, F.col("_mapped"))
    reason = (F.when(F.coalesce(F.trim("payload"), F.lit("")) == "", "empty")
              .when(F.col("d._bad").isNotNull() & F.coalesce(known, F.lit(False)), "partly readable")
              .when(F.col("d").isNull() | F.col("d._bad").isNotNull(), "malformed")
              .when(F.coalesce(F.size(tags), F.lit(0)) < 1, "no facts")
              .when(~known, "no mapped tags"))
    return read.select("entity_id", reason.alias("reason")).filter("reason is not null")


def companies_from_map(documents: DataFrame) -> DataFrame:
    """Company-map JSON (column ``payload``) to (position, entity_id, ticker, company_name).

    ``position`` is the place in the map. Not unique per entity: classes of one company's shares
    keep a row each.
    """
    each = documents.select(F.posexplode(F.from_json("payload", schemas.COMPANY_MAP))
                            .alias("position", "_name", "company"))
    return each.select(
        "position", F.lpad(F.col("company.cik_str").cast("string"), 10, "0").alias("entity_id"),
        F.col("company.ticker").alias("ticker"), F.col("company.title").alias("company_name"))


def price_frame(history: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Vendor price history (Date with time zone, Close) to (ticker, date, close)."""
    renamed = history.withColumnRenamed("Close", "close")
    return renamed.select(F.col(ticker).alias("ticker"),
                          F.to_date("Date").alias("date"), F.col("close").cast("double"))


def constituents(table: DataFrame) -> DataFrame:
    """Index page table (Symbol, Security, GICS Sector) to the sector table's columns."""
    return table.select(F.replace("Symbol", F.lit("."), F.lit("-")).alias("ticker"),
                        F.col("Security").alias("company_name"),
                        F.col("GICS Sector").alias("gics_sector"))
