import pytest
from pyspark.sql import functions as F

from asfiled import fixed
from asfiled.operators.staging import concept_table, stage_facts, tag_table


def staged_one(facts, **row):
    rows = stage_facts(facts(row)).collect()
    return rows[0] if rows else None


@pytest.mark.parametrize("end, year", [
    ("2012-01-01", 2011), ("2012-12-30", 2012), ("2020-01-10", 2019), ("2020-01-11", 2020),
    ("2015-06-30", 2015)])
def test_fiscal_year_of_period(facts, end, year):
    row = staged_one(facts, period_start=None, period_end=end, filed_date="2021-01-01")
    assert row.period_fiscal_year == year


@pytest.mark.parametrize("start, kind", [
    (None, "instant"), ("2015-01-01", "annual"), ("2015-10-01", "quarter"),
    ("2015-07-01", "half"), ("2015-04-01", "three_quarter"), ("2015-11-15", "other")])
def test_period_class(facts, start, kind):
    assert staged_one(facts, period_start=start).period_type == kind


def test_sign_slip_is_normalised_only_for_magnitudes(facts):
    slipped = staged_one(facts, concept="sga", value=-5.0)
    assert (slipped.value, slipped.sign_was_negative) == (5.0, True)
    benefit = staged_one(facts, concept="income_tax_expense", value=-5.0)
    assert (benefit.value, benefit.sign_was_negative) == (-5.0, False)


def test_unusable_rows_are_dropped(facts):
    assert staged_one(facts, filed_date="2015-12-31") is None
    assert staged_one(facts, value=None) is None
    assert staged_one(facts, period_end=None) is None
    assert staged_one(facts, period_start="2009-01-01", period_end="2009-12-31") is None


def test_unknown_concept_gets_default_metadata(facts):
    row = staged_one(facts, concept="goodwill", value=-1.0)
    assert (row.sign_convention, row.restatement_eligible, row.combine_mode, row.value) == (
        "any", True, "best", -1.0)


def test_own_concept_table_replaces_the_fixed_one(spark, facts):
    meta = concept_table(spark).withColumn("sign_convention", F.lit("always_positive"))
    assert stage_facts(facts({"value": -3.0}), meta).first().value == 3.0


def test_each_tag_has_one_concept_and_first_definition_wins(spark):
    tags = [t for c in fixed.CONCEPTS for t in c.tags]
    assert len(tags) == len(set(tags)) == tag_table(spark).count()
    again = fixed.CONCEPTS + (fixed.Concept("late", "duration", "x", False, "any", True, "best",
                                            ("Revenues",)),)
    row = tag_table(spark, again).filter("source_tag = 'Revenues'").collect()
    assert [(r.concept, r.tag_priority) for r in row] == [("revenue", 2)]


def test_concept_metadata(spark):
    table = {r.concept: r for r in concept_table(spark).collect()}
    assert len(table) == len(fixed.CONCEPTS)
    assert fixed.SUMMED_CONCEPTS == ("cogs",)
    assert not table["shares_diluted"].restatement_eligible
    assert table["income_tax_expense"].sign_convention == "any"
    gross = next(c for c in fixed.CONCEPTS if c.concept == "interest_expense")
    assert "InterestIncomeExpenseNet" not in gross.tags
