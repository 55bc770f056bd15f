"""Both plans of the bitemporal table on random facts, and on very many copies of one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from asfiled.operators.bitemporal import financials_pit
from asfiled.operators.staging import stage_facts


WHOLE = (100, 200, -300, 400)
#: Amounts whose sum as doubles depends on the order, of several magnitudes.
FRACTIONS = (0.1, 0.2, 0.3, 7.9, -3.3, 1e15 + 0.125, 1e15 - 0.375, 123456.789, 1e-9, 99.99)


def random_facts(rng, n, amounts=WHOLE):
    """Two starts per tag, missing accessions, ties, several names, totals beside components."""
    rows = []
    for _ in range(n):
        year = rng.choice([2014, 2015])
        concept, tag, rank = rng.choice([
            ("cogs", "CostOfGoodsSold", 2), ("cogs", "CostOfServices", 3),
            ("cogs", "CostOfRevenue", 0), ("revenue", "Revenues", 2), ("revenue", "SalesRevenueNet", 3),
            ("total_assets", "Assets", 0)])
        instant = concept == "total_assets"
        rows.append({
            "entity_id": rng.choice(["1", "2"]), "ticker": rng.choice(["AAA", "AAB"]),
            "company_name": rng.choice(["A Co", "A Company"]), "concept": concept,
            "source_tag": tag, "tag_priority": rank,
            "period_start": None if instant else f"{year}-01-0{rng.choice([1, 1, 5])}",
            "period_end": f"{year}-12-31", "fiscal_year": year,
            "form": rng.choice(["10-K", "10-K/A"]),
            "filed_date": f"{year + 1}-0{rng.randrange(2, 5)}-1{rng.randrange(3)}",
            "accession": rng.choice([None, "X-1", "X-2", "X-3"]),
            "value": float(rng.choice(amounts))})
    return rows


@pytest.mark.parametrize("amounts", [WHOLE, FRACTIONS], ids=["whole", "fractions"])
@pytest.mark.parametrize("seed", range(3))
def test_both_plans_give_the_same_rows(spark, facts, seed, amounts):
    staged = stage_facts(facts(*random_facts(random.Random(seed), 500, amounts)))
    together = financials_pit(staged, row_limit=10 ** 9)
    apart = financials_pit(staged, row_limit=0)
    assert together.columns == apart.columns
    one, two = (sorted(map(str, df.collect())) for df in (together, apart))
    assert one == two and len(one) > 20
    assert any("CostOfGoodsSold+" in r for r in one)


def test_columns_of_a_sum_are_the_largest_of_its_parts(facts):
    cogs = {"concept": "cogs", "source_tag": "CostOfGoodsSold", "tag_priority": 2}
    rows = facts({**cogs, "period_start": "2015-01-01", "value": 100.0},
                 {**cogs, "period_start": "2015-01-05", "value": 200.0})
    for limit in (0, 10 ** 9):
        row = financials_pit(stage_facts(rows), row_limit=limit).first()
        assert (str(row.period_start), row.value) == ("2015-01-05", 300.0)


def test_copies_of_one_component_take_linear_time(spark, facts):
    one = facts({"concept": "cogs", "source_tag": "CostOfGoodsSold", "tag_priority": 2})
    many = one.crossJoin(spark.range(100_000)).drop("id").coalesce(1)
    began = time.perf_counter()
    row = financials_pit(stage_facts(many)).first()
    assert row.value == 1.0 and row.n_reports == 1
    assert time.perf_counter() - began < 60


def components(rng, n):
    """Sums of up to thirty parts per filing, each part another period start or unit."""
    rows = []
    for i in range(n):
        year = rng.choice([2014, 2015])
        rows.append({"concept": "cogs", "source_tag": rng.choice(["CostOfGoodsSold", "CostOfServices"]),
                     "tag_priority": 2, "period_start": f"{year}-01-{rng.randrange(1, 15):02}",
                     "period_end": f"{year}-12-31", "fiscal_year": year, "unit": rng.choice(["USD", "shares"]),
                     "filed_date": f"{year + 1}-02-15", "accession": f"{year}-{rng.randrange(3)}",
                     "value": float(rng.choice(FRACTIONS)) * rng.choice([1, 10, 0.01])})
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_sums_agree_over_plans_partitions_and_engines(spark, facts, seed):
    import duckdb

    from harness.oracle import pit_of
    rows = facts(*components(random.Random(seed), 400))
    columns = ("accession", "period_end", "value", "first_reported_value", "latest_reported_value")
    seen = set()
    for parts in (1, 7):
        for limit in (10 ** 9, 0):
            got = financials_pit(stage_facts(rows.repartition(parts)), row_limit=limit)
            seen.add(tuple(sorted(map(repr, (tuple(r) for r in got.select(
                "accession", F.col("period_end").cast("string"), *columns[2:]).collect())))))
    assert len(seen) == 1
    con = duckdb.connect()
    con.register("told_facts", rows.toArrow())
    twin = con.execute(pit_of("told_facts", "select accession, cast(period_end as varchar), value, "
                              "first_reported_value, latest_reported_value from pit")).fetchall()
    assert tuple(sorted(map(repr, twin))) == seen.pop()


def test_an_amount_beyond_the_decimals_is_still_summed(facts):
    cogs = {"concept": "cogs", "tag_priority": 2}
    rows = facts({**cogs, "source_tag": "CostOfGoodsSold", "value": 1e30},
                 {**cogs, "source_tag": "CostOfServices", "value": 2e30})
    for limit in (0, 10 ** 9):
        assert financials_pit(stage_facts(rows), row_limit=limit).first().value == 1e30 + 2e30


def test_table_build_leans_on_its_two_sorts_alone(facts):
    # An aggregate that collects hashes its groups and beyond a few of them sorts all rows again.
    plan = financials_pit(stage_facts(facts({})))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan
    assert "ObjectHashAggregate" not in plan
