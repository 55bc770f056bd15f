"""Explicit schemas of the tables the library reads and writes. Nothing is inferred."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(),
             "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}
    fields = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields])


FACTS = _struct(
    "entity_id string, ticker string, company_name string, concept string, source_tag string, "
    "tag_priority int, unit string, period_start date, period_end date, fiscal_year int, "
    "fiscal_period string, form string, filed_date date, accession string, frame string, "
    "value double"
)
FLAT_FACTS = T.StructType([f for f in FACTS if f.name not in ("ticker", "company_name")])
PRICES = _struct("ticker string, date date, close double")
SECTORS = _struct("ticker string, company_name string, gics_sector string")
CONCEPTS = _struct(
    "concept string, kind string, statement string, required boolean, sign_convention string, "
    "restatement_eligible boolean, combine string"
)
CASE_STUDIES = _struct("ticker string, case_study_note string")
EVENTS = _struct(
    "ticker string, event_label string, as_of_date date, public_event_date date, "
    "event_description string"
)
COMPANIES = _struct("entity_id string, ticker string, company_name string")

# Nested input documents.
COMPANY_MAP = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
OBSERVATION = (
    "struct<start: string, `end`: string, val: double, accn: string, fy: int, fp: string, "
    "form: string, filed: string, frame: string>"
)
FILING_DOCUMENT = (
    "struct<facts: map<string, map<string, struct<units: map<string, array<"
    + OBSERVATION + ">>>>>>"
)

# The flat screener table, as written to and read back from CSV.
SCREENER = _struct(
    "entity_id string, ticker string, company_name string, gics_sector string, "
    "is_case_study boolean, case_study_note string, period_fiscal_year int, period_end date, "
    "m_score double, z_score double, z_zone string, f_score int, f_band string, "
    "m_score_flag boolean, z_score_flag boolean, f_score_flag boolean, red_flag_count int, "
    "models_scored int"
)
