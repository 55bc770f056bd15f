"""Every registered query against DuckDB on the smallest data set, and the shape of its plan."""

import re
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harness.check import compare, duck
from harness.inputs import inputs
from harness.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are absent")
BUILDS, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_query_matches_duckdb(spark, con, name):
    verdict = compare(spark, con, BUILDS[name], ORACLE.get(name), SF_DIR)
    assert verdict.startswith(("ok", "rows only")), verdict


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_query_multiplies_rows_or_sorts_in_one_task(spark, name):
    plan = plan_of(BUILDS[name](spark, SF_DIR))
    # The one-row list of mapped tags may be joined to every document.
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan or name == "rejected_filings"
    assert not re.search("PythonUDF|ArrowEvalPython|BatchEvalPython|MapInArrow|InPandas", plan)


def test_table_build_has_one_exchange_and_two_sorts(spark):
    plan = plan_of(inputs(spark, SF_DIR).build_pit())
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 2
    assert "IsNotNull(value)" in plan and "In(form" in plan


def test_scores_add_no_exchange_on_the_company(spark):
    plan = plan_of(BUILDS["facts_to_scores"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning\(entity_id", plan)) == 1


def test_prices_are_folded_before_they_are_shuffled(spark):
    plan = plan_of(BUILDS["nearest_price"](spark, SF_DIR))
    assert "partial_max(if ((_day" in plan


def test_counting_heavy_companies_reads_one_column(spark):
    from asfiled.operators import volume
    facts = inputs(spark, SF_DIR).facts
    plan = plan_of(facts.groupBy("entity_id").count().filter(f"count > {volume.ROW_LIMIT}"))
    assert "ReadSchema: struct<entity_id:string>" in plan


def test_flagship_has_a_stable_schema(spark):
    df = entry(spark)
    assert df.count() == 70
    assert [f.name for f in df.schema][:3] == ["entity_id", "ticker", "company_name"]
