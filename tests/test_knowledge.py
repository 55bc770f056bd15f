"""Knowledge intervals: against the table rebuilt on every date, and strict years against rebuilds."""

import random

import pytest
from pyspark.sql import functions as F

from asfiled.operators.bitemporal import financials_pit
from asfiled.operators.knowledge import knowledge_intervals, known_on, unsettled_companies
from asfiled.operators.staging import stage_facts
from asfiled.operators.wide import company_years
from asfiled.plans import backtest
from conftest import day


def filings(rng, companies=6, odd=False):
    """Tags that come and go, restated values, amended filings, changed year ends, foreign forms."""
    rows = []
    for c in range(companies):
        for year in (2013, 2014, 2015):
            for told in range(rng.randrange(1, 5)):
                accession = f"{c}-{year}-{told}"
                filed = f"{year + 1 + told // 2}-0{rng.randrange(2, 5)}-1{rng.randrange(3)}"
                for concept, tags in (("revenue", ["Revenues", "SalesRevenueNet"]),
                                      ("cogs", ["CostOfGoodsSold", "CostOfServices"]),
                                      ("net_income", ["NetIncomeLoss"]), ("total_assets", ["Assets"])):
                    for tag in rng.sample(tags, rng.randrange(1, len(tags) + 1)):
                        end = rng.choice(["12-31", "12-31", "12-31", "11-30"])
                        rows.append({
                            "entity_id": str(c), "ticker": f"T{c}", "company_name": f"C{c}",
                            "concept": concept, "source_tag": tag, "tag_priority": len(tag),
                            "period_start": None if concept == "total_assets" else
                            f"{year - (end == '11-30')}-{'12-01' if end == '11-30' else '01-01'}",
                            "period_end": f"{year}-{end}", "fiscal_year": year, "filed_date": filed,
                            "form": rng.choice(["10-K", "10-K", "20-F"]), "accession": accession,
                            "value": float(rng.choice([100, 200, 300, 7.9, 0.1]))})
    if odd:
        # Some figures without accession only, some with and without.
        for r in rows:
            if r["concept"] == "net_income" and int(r["entity_id"]) % 2:
                r["accession"] = None
                r["form"] = "10-K"
        for r in rng.sample(rows, 3):
            r["accession"] = None
        for r in rng.sample(rows, 3):
            r["filed_date"] = "2016-05-05"
        rows[0]["ticker"] = "OTHER"
    return rows


def state(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_a_date_is_a_filter_instead_of_a_rebuild(facts, seed):
    staged = stage_facts(facts(*filings(random.Random(seed))))
    pit = financials_pit(staged)
    intervals = knowledge_intervals(pit)
    for date in ("2014-02-12", "2015-03-11", "2016-12-31"):
        rebuilt = financials_pit(staged.filter(F.col("filed_date") <= day(date)))
        want = rebuilt.filter("in_lineage").groupBy("entity_id", "concept", "period_end").agg(
            F.max("latest_tag"), F.max("n_distinct_tags"), F.max("n_reports"),
            F.max("first_reported_value"), F.max("latest_reported_value"), F.max("first_filed_date"),
            F.max(F.when(F.col("report_version") == 1, F.col("form"))))
        got = intervals.filter(known_on(intervals, F.lit(date).cast("date"))).select(
            "entity_id", "concept", "period_end", "latest_tag", "n_distinct_tags", "n_reports", "value",
            "latest_reported_value", "first_filed_date", "form")
        assert state(got.toDF(*want.columns)) == state(want) and want.count() > 5


def test_intervals_of_a_figure_follow_each_other_without_gaps(facts):
    intervals = knowledge_intervals(financials_pit(stage_facts(facts(*filings(random.Random(7))))))
    figures = {}
    for r in intervals.collect():
        figures.setdefault((r.entity_id, r.concept, r.period_end), []).append((r.known_from, r.known_to))
    assert any(len(spans) > 2 for spans in figures.values())
    for spans in figures.values():
        spans.sort()
        assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[-1][1] is None


@pytest.mark.parametrize("seed,odd", [(0, False), (1, True), (2, True)])
def test_strict_years_are_those_of_a_rebuild(spark, facts, seed, odd):
    staged = stage_facts(facts(*filings(random.Random(seed), odd=odd)))
    events = spark.createDataFrame(
        [(t, f"e{i}", day(d), day(d), "x") for t in ("T0", "T1", "T2", "T5", "OTHER", "NONE")
         for i, d in enumerate(("2014-02-11", "2015-04-01", "2099-01-01"))],
        "ticker string, event_label string, as_of_date date, public_event_date date, "
        "event_description string")
    want = company_years(backtest.strict_pit(staged, events), backtest._WORLD)
    got = backtest.strict_years(staged, events)
    assert sorted(got.columns) == sorted(want.columns)
    assert state(got.select(want.columns)) == state(want) and want.count() > 8
    if odd:
        assert 0 < unsettled_companies(staged).count() <= 6


def test_unsettled_companies(facts):
    plain = {"concept": "revenue", "period_end": "2015-12-31"}
    rows = [{**plain, "entity_id": "1"}, {**plain, "entity_id": "2", "accession": None},
            {**plain, "entity_id": "3", "accession": "A"},
            {**plain, "entity_id": "3", "accession": "A", "filed_date": "2016-03-03"},
            {**plain, "entity_id": "4", "ticker": "X"}, {**plain, "entity_id": "4", "ticker": "Y"},
            {**plain, "entity_id": "5", "form": "8-K", "accession": None},
            {**plain, "entity_id": "6", "ticker": None}, {**plain, "entity_id": "2"},
            {**plain, "entity_id": "7"}, {**plain, "entity_id": "7", "concept": "cogs", "accession": None,
                                          "source_tag": "CostOfServices"},
            {**plain, "entity_id": "8"}, {**plain, "entity_id": "8", "concept": "cogs", "accession": None,
                                          "form": "20-F"}]
    staged = stage_facts(facts(*rows))
    assert {r[0] for r in unsettled_companies(staged).collect()} == {"2", "3", "4", "6", "8"}
    assert unsettled_companies(staged, 0).count() == 7


def test_no_facts(facts, spark):
    staged = stage_facts(facts({}).limit(0))
    assert knowledge_intervals(financials_pit(staged)).count() == 0
    assert unsettled_companies(staged).count() == 0
