import pytest
from pyspark.sql import functions as F

from asfiled.operators import clustered, wide
from asfiled.operators.bitemporal import financials_pit
from asfiled.operators.staging import stage_facts


@pytest.fixture(scope="module", autouse=True)
def warehouse(spark):
    yield
    for table in spark.catalog.listTables():
        if table.name.startswith("pit_"):
            spark.sql(f"drop table {table.name}")


@pytest.fixture
def pit(spark, facts):
    rows = [{"entity_id": f"{c:010d}", "concept": concept, "source_tag": tag, "tag_priority": 1,
             "period_start": f"{y}-01-01", "period_end": f"{y}-12-31", "fiscal_year": y,
             "filed_date": f"{y + 1}-02-15", "accession": f"{c}-{y}", "value": float(c * y)}
            for c in range(1, 9) for y in range(2012, 2012 + (9 if c == 3 else 2))
            for concept, tag in (("revenue", "Revenues"), ("net_income", "NetIncomeLoss"))]
    return financials_pit(stage_facts(facts(*rows)))


def build(part):
    return wide.with_previous_year(wide.company_years(part), ("revenue", "net_income"))


def test_pivot_and_window_read_buckets_without_an_exchange(spark, pit):
    parts = clustered.write_clustered(pit, "pit", 5)
    assert len(parts) == 1
    years = build(parts[0])
    plan = years._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert len(parts[0].inputFiles()) <= 5
    assert sorted(map(str, years.collect())) == sorted(map(str, build(pit).collect()))


def test_a_company_beyond_the_bound_is_in_no_bucket(spark, pit):
    limit = pit.groupBy("entity_id").count().agg(F.min("count")).first()[0]
    parts = clustered.write_clustered(pit, "pit", 5, row_limit=limit)
    assert [r[0] for r in parts[1].select("entity_id").distinct().collect()] == ["0000000003"]
    assert parts[0].filter("entity_id = '0000000003'").isEmpty()
    assert sorted(map(str, clustered.over_parts(parts, build).collect())) == sorted(
        map(str, build(pit).collect()))


def test_rows_without_a_company_and_empty_tables(spark, pit):
    odd = pit.limit(4).withColumn("entity_id", F.lit(None).cast("string")).unionByName(pit)
    for row_limit in (10**6, 3):
        parts = clustered.write_clustered(odd, "pit", 3, row_limit=row_limit)
        whole = clustered.over_parts(parts, lambda p: p)
        assert sorted(map(str, whole.collect())) == sorted(map(str, odd.collect()))
    empty = clustered.write_clustered(pit.limit(0), "pit", 3)
    assert len(empty) == 1 and empty[0].isEmpty() and empty[0].columns == pit.columns
