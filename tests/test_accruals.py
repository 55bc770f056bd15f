import math

import pytest

from asfiled.plans import accruals


@pytest.fixture(scope="module")
def panel(spark):
    """Lowest quintile earns 10 %, highest 0 %, two years of 20 names per cell."""
    base = {1: 0.10, 2: 0.05, 3: 0.05, 4: 0.05, 5: 0.0}
    rows = [(year, f"T{year}{q}{i}", -0.5 + 0.1 * q, base[q] + 0.001 * (i - 10), q)
            for year in (2020, 2021) for q in base for i in range(20)]
    return spark.createDataFrame(rows, "period_fiscal_year int, ticker string, tata double, "
                                       "fwd_return_12m double, accrual_quintile int")


def test_known_answer(panel):
    stats = accruals.quintile_stats(panel)
    rows = {r.accrual_quintile: r for r in stats.collect()}
    assert rows[1].n == 40 and rows[1].mean_return == pytest.approx(0.10, abs=1e-3)
    assert rows[5].mean_return == pytest.approx(0.0, abs=1e-3)
    assert rows[3].median_return == pytest.approx(0.0495)
    test = accruals.hedge_test(stats, panel).first()
    assert test.hedge_return == pytest.approx(0.10, abs=1e-3)
    assert test.median_hedge_return == pytest.approx(0.10, abs=1e-3)
    assert test.n_years == 2 and test.t_stat > 0 and test.p_value < 0.001


def test_no_spread_gives_no_t(spark):
    rows = [(2020, "a", 0.1, 0.2, 1), (2020, "b", 0.1, 0.2, 1), (2020, "c", 0.3, 0.1, 5),
            (2020, "d", 0.3, 0.1, 5)]
    flat = spark.createDataFrame(rows, "period_fiscal_year int, ticker string, tata double, "
                                       "fwd_return_12m double, accrual_quintile int")
    test = accruals.hedge_test(accruals.quintile_stats(flat), flat).first()
    assert math.isnan(test.t_stat)


def test_report_names_every_quintile(panel):
    stats = accruals.quintile_stats(panel)
    lines = accruals.report_lines(stats, accruals.hedge_test(stats, panel)).orderBy("line_no")
    text = [r.line for r in lines.collect()]
    assert len(text) == 9 and all(text[1 + q].startswith(f" {q}") for q in range(1, 6))
    assert "Hedge return" in text[7] and "10.0000%" in text[7]
