"""Every case runs on both plans: companies kept together, and companies split apart."""

import random

import pytest

from asfiled.operators.bitemporal import financials_pit
from asfiled.operators.staging import stage_facts
from asfiled.operators.volume import heavy_keys

PLANS = pytest.mark.parametrize("row_limit", [10**9, 0], ids=["together", "apart"])


def build(facts, rows, row_limit):
    return financials_pit(stage_facts(facts(*rows)), row_limit=row_limit)


def told(period_end="2015-12-31", filed="2016-02-15", accession="X-1", **more):
    year = int(period_end[:4])
    return {"period_start": f"{year}-01-01", "period_end": period_end, "filed_date": filed,
            "accession": accession, **more}


@PLANS
def test_instant_needs_a_full_year_in_the_same_filing(facts, row_limit):
    asset = {"concept": "total_assets", "source_tag": "Assets"}
    rows = [told(), {**told(), **asset, "period_start": None},
            {**told("2015-04-01"), **asset, "period_start": None},
            {**told(accession=None), **asset, "period_start": None},
            {**told("2014-12-31"), **asset, "period_start": None, "accession": "other"}]
    kept = build(facts, rows, row_limit).filter("concept = 'total_assets'").collect()
    assert [str(r.period_end) for r in kept] == ["2015-12-31"]


@PLANS
def test_a_full_year_in_another_unit_still_anchors(facts, row_limit):
    rows = [told(unit="CNY"), {**told(), "concept": "total_assets", "source_tag": "Assets",
                               "period_start": None}]
    assert [r.concept for r in build(facts, rows, row_limit).collect()] == ["total_assets"]


@PLANS
def test_components_are_summed_once_each(facts, row_limit):
    cost = {"concept": "cogs", "tag_priority": 2, "source_tag": "CostOfGoodsSold"}
    service = {**cost, "tag_priority": 3, "source_tag": "CostOfServices"}
    rows = [{**told(), **cost, "value": 56785.0}, {**told(), **cost, "value": 56785.0},
            {**told(), **service, "value": -17525.0}]
    row, = build(facts, rows, row_limit).collect()
    assert (row.value, row.source_tag) == (74310.0, "CostOfGoodsSold+CostOfServices")
    assert row.sign_was_negative and not row.was_restated and row.is_first_report


@PLANS
def test_best_tag_by_priority_then_larger_value(facts, row_limit):
    rows = [told(source_tag="SalesRevenueNet", tag_priority=3, value=9.0),
            told(source_tag="Revenues", value=5.0), told(source_tag="Revenues", value=7.0)]
    row, = build(facts, rows, row_limit).collect()
    assert (row.source_tag, row.value) == ("Revenues", 7.0)


@PLANS
def test_tag_switch_leaves_the_lineage(facts, row_limit):
    rows = [told(value=70.0, source_tag="SalesRevenueNet", tag_priority=3),
            told(value=-608.0, filed="2017-02-15", accession="X-2")]
    old, new = sorted(build(facts, rows, row_limit).collect(), key=lambda r: r.accession)
    assert old.tag_switch_detected and not old.in_lineage
    assert (old.report_version, old.restatement_pct, old.was_restated) == (None, None, False)
    assert (new.report_version, new.n_reports, new.restatement_pct) == (1, 1, 0.0)
    assert new.is_first_report and old.is_first_report is None


@PLANS
def test_restatement_within_one_tag(facts, row_limit):
    cfo = {"concept": "cfo", "source_tag": "N"}
    rows = [{**told(value=-244.0), **cfo},
            {**told(value=1160.0, filed="2017-02-01", accession="X-2"), **cfo},
            {**told(value=1160.0, filed="2018-02-01", accession="X-3"), **cfo}]
    out = sorted(build(facts, rows, row_limit).collect(), key=lambda r: r.accession)
    assert [r.report_version for r in out] == [1, 2, 3]
    assert all(r.was_restated and r.restatement_pct == pytest.approx(1404 / 244) for r in out)
    assert [r.is_latest_report for r in out] == [False, False, True]
    assert (out[0].first_reported_value, out[0].latest_reported_value) == (-244.0, 1160.0)


@PLANS
@pytest.mark.parametrize("later, restated", [(1004.0, False), (1006.0, True)])
def test_half_a_percent_is_tolerated(facts, row_limit, later, restated):
    rows = [told(value=1000.0), told(value=later, filed="2017-02-01", accession="X-2")]
    assert {r.was_restated for r in build(facts, rows, row_limit).collect()} == {restated}


@PLANS
def test_first_value_zero_is_not_compared(facts, row_limit):
    rows = [told(value=0.0), told(value=5.0, filed="2017-02-01", accession="X-2")]
    assert {(r.restatement_pct, r.was_restated)
            for r in build(facts, rows, row_limit).collect()} == {(None, False)}


@PLANS
def test_changed_year_end_keeps_one_canonical_period(facts, row_limit):
    june = {"period_start": "2018-07-01", "period_end": "2019-06-28", "filed_date": "2019-08-01"}
    january = {"period_start": "2019-01-05", "period_end": "2020-01-03",
               "filed_date": "2020-03-01", "accession": "X-2"}
    rows = [june, {**june, "concept": "cfo", "source_tag": "N"}, january]
    out = build(facts, rows, row_limit).collect()
    assert {r.period_fiscal_year for r in out} == {2019}
    assert {str(r.period_end) for r in out if r.is_first_report} == {"2019-06-28"}
    tied = build(facts, [june, january], row_limit).filter("is_first_report").collect()
    assert {str(r.period_end) for r in tied} == {"2020-01-03"}


@PLANS
def test_missing_accession_carries_no_comparison(facts, row_limit):
    rows = [told(value=10.0), told(value=20.0, filed="2017-01-01", accession=None)]
    out = {r.accession: r for r in build(facts, rows, row_limit).collect()}
    assert out[None].report_version is None and out[None].is_latest_report is None
    assert (out["X-1"].n_reports, out["X-1"].latest_reported_value) == (2, 20.0)


def test_one_company_with_a_third_of_all_rows(facts):
    """A third of the rows tell one figure of one company; another third are exact copies."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        tag, rank = rng.choice([("Revenues", 2), ("SalesRevenueNet", 3)])
        rows.append(told(accession=f"H-{i:04}", source_tag=tag, tag_priority=rank,
                         filed=f"{rng.randint(2016, 2019)}-0{rng.randint(1, 9)}-10",
                         value=float(rng.randint(1, 50))))
    rows += [told(entity_id="0000000002", ticker="BBB", value=3.0)] * 400
    for i in range(400):
        rows.append(told(entity_id=f"{i % 40 + 10:010}", accession=f"N-{i}",
                         filed=f"2016-0{rng.randint(1, 9)}-20", value=float(i)))
    staged = stage_facts(facts(*rows))
    assert heavy_keys(staged, ["entity_id"], 100).count() == 2
    split = financials_pit(staged, row_limit=100).collect()
    whole = financials_pit(staged).collect()
    assert sorted(map(str, split)) == sorted(map(str, whole))
    assert len(whole) == 801
    hot = [r for r in whole if r.entity_id == "0000000001" and r.in_lineage]
    assert sorted(r.report_version for r in hot) == list(range(1, len(hot) + 1))
