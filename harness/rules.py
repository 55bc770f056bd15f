"""Integer rules that turn the driver tables into filings, prices and dimensions.

The driver tables hold no filings, so lineitem and supplier stand in for them: one supplier is a
company, one ship year (moved 15 years) a fiscal year, and each fiscal year is told again in up
to two later filings. Amounts are integers in cents, so both engines agree to the last digit. The
expressions are plain SQL that Spark and DuckDB read alike; ``//`` is integer division of
non-negative numbers and is spelled ``div`` for Spark.
"""

from __future__ import annotations

from typing import NamedTuple

START = "case when s % 5 = 0 then make_date(y, 1, 3) else make_date(y, 1, 1) end"
END = "case when s % 5 = 0 then make_date(y + 1, 1, 2) else make_date(y, 12, 31) end"
FILED = "make_date(y + v + 1, 2, 1) + cast((7*s + 3*(y+v)) % 45 as int)"
GOODS = "r * (50 + (3*s + y) % 11) // 100"
CFO = "r * ((s + 3*y) % 11) // 100"
NO_DATE = "cast(null as date)"


class Rule(NamedTuple):
    concept: str
    tag: str
    priority: int
    amount: str
    when: str = "true"
    start: str = START
    end: str = END
    unit: str = "USD"
    form: str = "form"
    accession: str = "accession"


def _instant(concept: str, tag: str, amount: str, when: str = "true", end: str = END, **more) -> Rule:
    return Rule(concept, tag, 0, amount, when, NO_DATE, end, **more)


_SWITCHED = "(v = 2 and (s + y) % 13 = 0)"
_RESTATED = "(v >= 1 and (s + y) % 11 = 0)"
_SGA = "r * (10 + (s + y) % 5) // 100"
_SHARES = "n * 10000 * (1 + s % 10)"
_SPLIT = "(s % 23 = 1 and y + v >= 2014)"
ASSETS = "r + q * 100000"

RULES: tuple[Rule, ...] = (
    Rule("revenue", "RevenueFromContractWithCustomerExcludingAssessedTax", 0, "r",
         f"not {_SWITCHED}"),
    Rule("revenue", "Revenues", 2, "r", _SWITCHED),
    Rule("revenue", "Revenues", 2, "r // 2", "s % 13 = 2", unit="EUR"),
    Rule("cogs", "CostOfGoodsSold", 2, GOODS),
    Rule("cogs", "CostOfGoodsSold", 2, GOODS, "s % 10 = 7"),
    Rule("cogs", "CostOfServices", 3, "d"),
    Rule("gross_profit", "GrossProfit", 0, f"r - {GOODS} - d", "s % 3 = 0"),
    Rule("operating_income", "OperatingIncomeLoss", 0,
         "r * (8 + (5*s + y) % 9) // 100 - d // 2"),
    Rule("net_income", "NetIncomeLoss", 0, "r * (3 + (5*s + y) % 9) // 100 - d // 2"),
    Rule("cfo", "NetCashProvidedByUsedInOperatingActivities", 0,
         f"case when {_RESTATED} then {CFO} * 104 // 100 else {CFO} end - d // 3"),
    Rule("sga", "SellingGeneralAndAdministrativeExpense", 0,
         f"case when (s + y) % 17 = 0 then -({_SGA}) else {_SGA} end", "s % 6 <> 5"),
    Rule("depreciation_amortisation", "DepreciationDepletionAndAmortization", 0,
         "r * (2 + (s + y) % 3) // 100"),
    _instant("receivables", "AccountsReceivableNetCurrent", "r * (10 + (2*s + 5*y) % 8) // 100"),
    _instant("current_assets", "AssetsCurrent", "r * (30 + (s + 2*y) % 15) // 100"),
    _instant("current_assets", "AssetsCurrent", "r * (30 + (s + 2*y) % 15) // 100", "s % 10 = 6"),
    _instant("total_assets", "Assets", ASSETS),
    _instant("ppe_net", "PropertyPlantAndEquipmentNet", "r * (20 + (s + y) % 10) // 100"),
    _instant("current_liabilities", "LiabilitiesCurrent", "r * (15 + (3*s + 7*y) % 12) // 100"),
    _instant("total_liabilities", "Liabilities", "r * (50 + (s + y) % 30) // 100", "s % 4 <> 1"),
    _instant("long_term_debt", "LongTermDebtNoncurrent", "r * (20 + (7*s + 3*y) % 20) // 100"),
    _instant("retained_earnings", "RetainedEarningsAccumulatedDeficit",
             "r * (s % 40) // 100 - r * 8 // 100", "s % 20 <> 13"),
    Rule("shares_diluted", "WeightedAverageNumberOfDilutedSharesOutstanding", 0,
         f"case when {_SPLIT} then {_SHARES} * 7 else {_SHARES} end", unit="shares"),
    # Quarter-end snapshot inside an annual filing, and a changed year end.
    _instant("total_assets", "Assets", ASSETS, "s % 7 = 0", "make_date(y, 3, 31)"),
    Rule("net_income", "NetIncomeLoss", 0, "r * 3 // 100", "s = 3 and y = 2013",
         "make_date(2012, 7, 1)", "make_date(2013, 6, 30)"),
    # Interim durations, which no annual table may keep.
    *[Rule("net_income", "NetIncomeLoss", 0, "r * 3 // 100", f"s % 7 = {i}",
           "make_date(y, 1, 1)", f"make_date(y, {month}, {day})")
      for i, month, day in ((1, 3, 31), (2, 6, 30), (3, 9, 30), (4, 4, 30))],
    # Two alternative tags side by side, and rows every cleaning step has to deal with.
    Rule("interest_expense", "InterestExpense", 0, "d // 5", "s % 6 = 1"),
    Rule("interest_expense", "InterestExpenseDebt", 1, "d // 4", "s % 6 = 1"),
    Rule("income_tax_expense", "IncomeTaxExpenseBenefit", 0, "r // 50", "s % 41 = 7",
         accession="cast(null as varchar(20))"),
    _instant("equity", "StockholdersEquity", "r // 3", "s % 41 = 7",
             accession="cast(null as varchar(20))"),
    _instant("inventory", "InventoryNet", "r // 9", "s % 9 = 2", form="'10-Q'"),
    _instant("total_assets", "Assets", ASSETS, "s % 17 = 3", f"{FILED} + 30"),
    Rule("capex", "PaymentsToAcquirePropertyPlantAndEquipment", 0, "cast(null as bigint)",
         "s % 17 = 4"),
)

CLOSE = "cast(10000 + (s % 50) * 100 + (k * 7 + 3*s) % 6000 as double) / 100"
NO_SECTOR = "s % 9 = 4"
CASE_STUDY = "s % 12 = 1"
AS_OF = "make_date(2012 + cast(s % 4 as int), 4, 1)"
