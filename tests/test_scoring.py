"""Scores against an independent plain-Python calculation on random company-years."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asfiled.operators import wide
from asfiled.plans import scoring

KIND = ", ".join(f"{c} double" for c in (*wide.CONCEPTS, "shares", "shares_current_basis"))
SCHEMA = ("entity_id string, period_end date, period_fiscal_year int, ticker string, "
          f"company_name string, {KIND}, is_foreign_filer boolean")


def div(a, b):
    return None if a is None or b is None or b == 0 else a / b


def less(a, b):
    return None if a is None or b is None else a - b


def plus(a, b):
    return None if a is None or b is None else a + b


def share(y, item, whole):
    return div(y.get(item), y.get(whole))


def expected(now, old, close):
    soft = lambda y: less(1, div(plus(y.get("current_assets"), y.get("ppe_net")),
                                 y.get("total_assets")))
    wear = lambda y: div(y.get("depreciation_amortisation"),
                         plus(y.get("depreciation_amortisation"), y.get("ppe_net")))
    change = lambda i, w: div(share(now, i, w), share(old, i, w))
    m = [change("receivables", "revenue"),
         div(share(old, "gross_profit", "revenue"), share(now, "gross_profit", "revenue")),
         div(soft(now), soft(old)), div(now["revenue"], old.get("revenue")),
         div(wear(old), wear(now)), change("sga", "revenue"),
         div(less(now["net_income"], now["cfo"]), now["total_assets"]),
         change("total_liabilities", "total_assets")]
    weights = [.920, .528, .404, .892, .115, -.172, 4.679, -.327]
    m_score = None if None in m else -4.84 + sum(w * v for w, v in zip(weights, m))

    value = None
    if not now["is_foreign_filer"] and close is not None and now["shares_current_basis"] is not None:
        value = close * now["shares_current_basis"]
    z = [div(less(now["current_assets"], now["current_liabilities"]), now["total_assets"]),
         share(now, "retained_earnings", "total_assets"),
         share(now, "operating_income", "total_assets"), div(value, now["total_liabilities"]),
         share(now, "revenue", "total_assets")]
    z_score = None if None in z else sum(w * v for w, v in zip([1.2, 1.4, 3.3, .6, 1.0], z))

    up = lambda a, b: None if a is None or b is None else int(a > b)
    rise = lambda i, w: up(share(now, i, w), share(old, i, w))
    f = [up(now["net_income"], 0), up(now["cfo"], 0), rise("net_income", "total_assets"),
         up(now["cfo"], now["net_income"]),
         up(share(old, "long_term_debt", "total_assets"),
            share(now, "long_term_debt", "total_assets")),
         rise("current_assets", "current_liabilities"),
         None if now["shares"] is None or old.get("shares") is None
         else int(now["shares"] <= old["shares"]),
         rise("gross_profit", "revenue"), rise("revenue", "total_assets")]
    return m, m_score, z, z_score, f, None if None in f else sum(f)


def test_scores_equal_plain_python(spark):
    rng = random.Random(5)
    years, names = [], [*wide.CONCEPTS, "shares", "shares_current_basis"]
    for company in range(40):
        for fy in sorted(rng.sample(range(2010, 2022), 8)):
            row = {"entity_id": f"{company:010}", "period_end": dt.date(fy, 12, 31),
                   "period_fiscal_year": fy, "ticker": f"T{company}", "company_name": "c",
                   "is_foreign_filer": company % 7 == 0}
            gaps = 0.02 if company % 2 else 0.2
            row |= {n: None if rng.random() < gaps else float(rng.randint(-3, 40)) for n in names}
            years.append(row)
    order = [f.split()[0] for f in SCHEMA.split(", ")]
    table = spark.createDataFrame([tuple(y[c] for c in order) for y in years], SCHEMA)
    closes = {(y["ticker"], y["period_end"]): float(rng.randint(1, 20))
              for y in years if rng.random() < 0.9}
    prices = spark.createDataFrame([(t, d, c) for (t, d), c in closes.items()],
                                   "ticker string, price_date date, close double")
    got = {(r.entity_id, r.period_fiscal_year): r
           for r in scoring.score_years(table, prices).collect()}
    assert len(got) == len(years)

    by_key = {(y["entity_id"], y["period_fiscal_year"]): y for y in years}
    scored = 0
    for (entity, fy), now in by_key.items():
        row = got[entity, fy]
        close = closes.get((now["ticker"], now["period_end"]))
        m, m_score, z, z_score, f, f_score = expected(now, by_key.get((entity, fy - 1), {}), close)
        for name, want in zip(scoring.INDICES + scoring.FACTORS + scoring.SIGNAL_COLUMNS,
                              m + z + f):
            assert row[name] == (want if want is None else pytest.approx(want, abs=1e-9)), name
        assert row.m_missing_inputs == [n for n, v in zip(scoring.INDICES, m) if v is None]
        assert row.z_missing_inputs == [n for n, v in zip(scoring.FACTORS, z) if v is None]
        assert row.missing_signals == [n for n, v in zip(scoring.SIGNALS, f) if v is None]
        for value, want in ((row.m_score, m_score), (row.z_score, z_score)):
            assert value == (want if want is None else pytest.approx(want, abs=6e-4))
        assert row.f_score == f_score
        assert row.band == (None if f_score is None else "strong" if f_score >= 8
                            else "weak" if f_score <= 2 else "neutral")
        assert row.zone == (None if z_score is None else "safe" if z_score > 2.99
                            else "grey" if z_score >= 1.81 else "distress")
        scored += m_score is not None
    assert scored > 10


def test_a_missing_year_has_no_previous(spark):
    years = spark.createDataFrame([("a", 2014, 1.0), ("a", 2016, 2.0), ("a", 2017, 3.0)],
                                  "entity_id string, period_fiscal_year int, revenue double")
    out = wide.with_previous_year(years, ("revenue",)).orderBy("period_fiscal_year")
    assert [r[0] for r in out.select(F.col("previous.revenue")).collect()] == [None, None, 2.0]
