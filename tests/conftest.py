import datetime as dt

import pytest
from pyspark.sql import SparkSession

from asfiled import schemas


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "4g")
               .config("spark.sql.codegen.cache.maxEntries", "2000")
               .config("spark.sql.session.timeZone", "UTC")
               # Must be set at start; a running session refuses it.
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return None if text is None else dt.date.fromisoformat(text)


@pytest.fixture
def facts(spark):
    """Make a fact table from short rows; unnamed columns get ordinary values."""
    usual = {"entity_id": "0000000001", "ticker": "AAA", "company_name": "A Co",
             "concept": "revenue", "source_tag": "Revenues", "tag_priority": 2, "unit": "USD",
             "period_start": "2015-01-01", "period_end": "2015-12-31", "fiscal_year": 2015,
             "fiscal_period": "FY", "form": "10-K", "filed_date": "2016-02-15",
             "accession": "X-1", "frame": None, "value": 1.0}

    def make(*rows):
        full = [{**usual, **r} for r in rows]
        for r in full:
            for c in ("period_start", "period_end", "filed_date"):
                r[c] = day(r[c])
        return spark.createDataFrame([tuple(r[c] for c in schemas.FACTS.names) for r in full],
                                     schemas.FACTS)
    return make
