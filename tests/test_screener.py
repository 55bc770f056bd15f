import math
import random

import pytest

from asfiled import schemas
from asfiled.functions.stats import normal_two_sided_p
from asfiled.plans import backtest, quality
from asfiled.plans import screener as screen


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        m = None if rng.random() < 0.2 else round(rng.gauss(-2.5, 1.5), 3)
        f = None if rng.random() < 0.2 else rng.randint(0, 9)
        flags = [None if m is None else m > -1.78, None, None if f is None else f <= 2]
        rows.append((f"{i % 50:010}", f"t{i % 50}", f"Comp {i % 50}", rng.choice(["X", "y", None]),
                     i % 9 == 0, None, 2010 + i // 50, None, m, None, None, f, None, *flags,
                     sum(map(bool, flags)), sum(x is not None for x in flags)))
    return spark.createDataFrame(rows, schemas.SCREENER).repartition(5)


def brute_histogram(values, bins, clip):
    values = sorted(v for v in values if v is not None)
    low = values[math.floor(len(values) * clip[0])]
    high = values[math.ceil(len(values) * clip[1]) - 1]
    counts, outside = [0] * bins, 0
    for v in values:
        outside += v < low or v > high
        spot = math.floor((v - low) / ((high - low) or 1) * bins)
        counts[min(bins - 1, max(0, spot))] += 1
    return counts, outside, low, high


@pytest.mark.parametrize("column, bins, clip", [
    ("m_score", 20, (0.05, 0.95)), ("f_score", 10, (0.0, 1.0))])
def test_histogram_equals_brute_force(table, column, bins, clip):
    got = screen.histogram(table, column, bins, clip).orderBy("bin").collect()
    counts, outside, low, high = brute_histogram(
        [r[0] for r in table.select(column).collect()], bins, clip)
    assert [r.n for r in got] == counts and sum(r.n_clipped for r in got) == outside
    assert {(r.low, r.high) for r in got} == {(low, high)}


def test_search_is_case_insensitive_and_conjunctive(table):
    rows = screen.search(table, " COMP 4", min_flags=1, first_year=2011, last_year=2014).collect()
    assert rows and all("comp 4" in r.company_name.lower() and r.red_flag_count >= 1
                        and 2011 <= r.period_fiscal_year <= 2014 for r in rows)
    assert all(r.is_case_study and r.gics_sector == "y" for r in
               screen.search(table, sector="y", cases_only=True).collect())
    assert screen.search(table, "100%").count() == 0


def test_sort_counts_null_as_smallest_and_ignores_case(table):
    up = [r.gics_sector for r in screen.sort_by(table, "gics_sector").collect()]
    assert up == sorted(up, key=lambda s: (s is not None, (s or "").lower()))
    down = [r.m_score for r in screen.sort_by(table, "m_score", descending=True).collect()]
    assert down == sorted(down, key=lambda v: -math.inf if v is None else v, reverse=True)


def test_pages_partition_the_order(table):
    pages = [screen.page(table, "m_score", number=i).collect() for i in range(7)]
    assert [len(p) for p in pages] == [50] * 6 + [0]
    assert len({(r.entity_id, r.period_fiscal_year) for p in pages for r in p}) == 300


def test_flag_rank_is_dense(table):
    rows = screen.flag_rank(table).collect()
    totals = sorted({r.total_red_flags for r in rows}, reverse=True)
    assert all(r.red_flag_rank == totals.index(r.total_red_flags) + 1 for r in rows)


def test_yearly_change_is_null_after_a_gap(table):
    rows = {r.period_fiscal_year: r
            for r in screen.yearly_change(table.filter("period_fiscal_year <> 2012")).collect()}
    assert rows[2013].previous_rate is None and rows[2011].previous_rate is not None
    assert rows[2011].change == pytest.approx(rows[2011].red_flag_rate - rows[2010].red_flag_rate)


def test_selected_value(table):
    assert screen.selected_value(table, "ticker", "UAA").first().ticker == "UAA"
    assert screen.selected_value(table.filter("ticker = 't3'"), "ticker", "UAA").first()[0] == "t3"


def test_leading_digit_of_small_and_large_values(spark):
    values = spark.createDataFrame([(0.0042,), (-7.5e15,), (1e300,), (0.0,), (999.0,)], "value double")
    assert {r.digit: r.n for r in screen.leading_digits(values).collect()} == {4: 1, 7: 1, 1: 1, 9: 1}


def test_checks_report_violations(spark, table):
    assert quality.inconsistent_flag_counts(table).count() == 0
    assert quality.outside_range(
        spark.createDataFrame([(151.0,), (150.0,), (None,)], "m_score double"), "m_score").count() == 1
    nulls = quality.null_violations(table, ["entity_id", "m_score"]).collect()
    assert [r.column for r in nulls] == ["m_score"]
    assert quality.outside_values(table, "gics_sector", ["X"]).select("gics_sector").distinct() \
        .first()[0] == "y"


def test_separate_scores_are_kept_when_one_model_is_missing(spark):
    who = "entity_id string, ticker string, company_name string, period_fiscal_year int"
    m = spark.createDataFrame([("1", "A", "a", 2015, -2.0)], who + ", m_score double")
    z = spark.createDataFrame([("1", "A", "a", 2016, None, 3.0, "safe")],
                              who + ", period_end date, z_score double, zone string")
    f = spark.createDataFrame([("1", "A", "a", 2015, None, 4, "neutral")],
                              who + ", period_end date, f_score int, band string")
    rows = {r.period_fiscal_year: r for r in screen.combine_scores(m, z, f).collect()}
    assert (rows[2015].m_score, rows[2015].z_score, rows[2015].f_score) == (-2.0, None, 4)
    assert (rows[2016].m_score, rows[2016].z_score, rows[2016].ticker) == (None, 3.0, "A")


def test_strict_backtest_forgets_later_filings(spark, facts):
    """A later filing switches the tag: the loose view loses the old figure, the strict keeps it."""
    from asfiled.operators.bitemporal import financials_pit
    from asfiled.operators.staging import stage_facts

    rows = [{"source_tag": "SalesRevenueNet", "tag_priority": 3, "value": 70.0},
            {"value": 90.0, "filed_date": "2018-02-15", "accession": "X-2"}]
    staged = stage_facts(facts(*rows))
    events = spark.sql("select 'AAA' as ticker, 'pre' as event_label, date'2017-01-01' as as_of_date, "
                       "date'2017-06-01' as public_event_date, '' as event_description")
    strict = backtest.strict_years(staged, events.union(events)).collect()
    assert [r.revenue for r in strict] == [70.0]
    assert backtest.visible_years(financials_pit(staged), events).count() == 0
    apart = backtest.strict_years(staged, events, row_limit=0).collect()
    assert [r.revenue for r in apart] == [70.0]


@pytest.mark.parametrize("column,descending", [("m_score", True), ("m_score", False), ("gics_sector", False),
                                               ("gics_sector", True), ("red_flag_count", True)])
def test_pages_follow_each_other_by_the_last_row(spark, column, descending):
    rng = random.Random(3)
    rows = [(str(i), 2010 + i % 4, rng.choice([None, 0.5, -1.0, 2.25]), rng.choice([None, "Tech", "tech", "Oil"]),
             rng.randrange(3)) for i in range(57)]
    table = spark.createDataFrame(rows, "entity_id string, period_fiscal_year int, m_score double, "
                                        "gics_sector string, red_flag_count int")
    want = screen.sort_by(table, column, descending, ("entity_id", "period_fiscal_year")).collect()
    got, last = [], None
    while True:
        page = screen.page_after(table, last, column, descending, rows=10).collect()
        if not page:
            break
        got, last = got + page, page[-1]
    assert got == want


def test_p_values_are_those_of_the_error_function(spark):
    values = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.96, 2.5758, 3.3, 5.0, 7.01, 7.99, 8.5, 40.0, -1.96, -6.0]
    df = spark.createDataFrame([(v,) for v in values], "t double").select(
        "t", normal_two_sided_p("t").alias("p"))
    for r in df.collect():
        assert abs(r.p - math.erfc(abs(r.t) / math.sqrt(2))) < 1e-9
