"""Tasks get a bounded number of rows, whatever the number of companies."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from asfiled.operators import bitemporal, clustered, knowledge, volume
from asfiled.operators.staging import stage_facts
from asfiled.sources import readers


@pytest.fixture
def pit(facts):
    rows = [{"entity_id": f"{i:010d}", "accession": f"A{i}-{v}", "value": float(v),
             "filed_date": f"201{6 + v}-02-15"} for i in range(120) for v in range(3)]
    table = stage_facts(facts(*rows))
    return lambda: bitemporal.financials_pit(table)


def most_in_a_partition(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_the_table_and_its_intervals_are_dealt_by_rows(pit, monkeypatch):
    whole = sorted(knowledge.knowledge_intervals(pit()).collect())
    monkeypatch.setattr(volume, "TASK_ROWS", 10)
    made = pit()
    assert made.rdd.getNumPartitions() == 36
    assert most_in_a_partition(made) < 60
    assert knowledge.knowledge_intervals(made).rdd.getNumPartitions() == 36
    assert sorted(knowledge.knowledge_intervals(made).collect()) == whole


def test_buckets_follow_the_rows(pit, monkeypatch):
    monkeypatch.setattr(volume, "TASK_ROWS", 10)
    parts = clustered.write_clustered(pit(), "pit")
    assert parts[0].groupBy("entity_id").count().rdd.getNumPartitions() == 36
    assert sum(p.count() for p in parts) == 360


def test_a_document_is_parsed_once(spark):
    told = {"start": "2015-01-01", "end": "2015-12-31", "val": 1.0, "accn": "A", "fy": 2015,
            "fp": "FY", "form": "10-K", "filed": "2016-02-15"}
    whole = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [told]}}}}}
    rows = [("1", json.dumps(whole)), ("2", json.dumps({"facts": {"us-gaap": {}}})), ("3", "no"), ("4", None)]
    found = readers.flatten_filings(spark.createDataFrame(rows, "entity_id string, payload string")
                                    .repartition(2))
    assert [(r.entity_id, r.concept, r.filed_date) for r in found.collect()] == [
        ("1", "revenue", dt.date(2016, 2, 15))]
    optimised = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("from_json") == 1
