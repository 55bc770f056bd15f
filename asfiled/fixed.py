"""Fixed values.

Everything in this module has to equal published constants or an agreed lookup table for the
results to be right; there is no logic here. Later modules import from it and never repeat a
value.
"""

from __future__ import annotations

from typing import NamedTuple


class Concept(NamedTuple):
    concept: str
    kind: str
    statement: str
    required: bool
    sign_convention: str
    restatement_eligible: bool
    combine: str
    tags: tuple[str, ...]


# --- fixed values: concept table, tags in priority order -------------------------------------
CONCEPTS: tuple[Concept, ...] = (
    Concept("revenue", "duration", "income_statement", True, "any", True, "best", (
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet")),
    Concept("cogs", "duration", "income_statement", True, "always_positive", True, "sum", (
        "CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold", "CostOfServices")),
    Concept("gross_profit", "duration", "income_statement", False, "any", True, "best", (
        "GrossProfit",)),
    Concept("operating_income", "duration", "income_statement", True, "any", True, "best", (
        "OperatingIncomeLoss",)),
    Concept("net_income", "duration", "income_statement", True, "any", True, "best", (
        "NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic")),
    Concept("sga", "duration", "income_statement", False, "always_positive", True, "best", (
        "SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense",
        "SellingGeneralAndAdministrativeExpenses")),
    Concept("depreciation_amortisation", "duration", "cash_flow", False, "always_positive",
            True, "best", (
                "DepreciationDepletionAndAmortization", "DepreciationAndAmortization",
                "DepreciationAmortizationAndAccretionNet", "Depreciation")),
    Concept("interest_expense", "duration", "income_statement", False, "always_positive",
            True, "best", ("InterestExpense", "InterestExpenseDebt")),
    Concept("interest_income_expense_net", "duration", "income_statement", False, "any",
            True, "best", ("InterestIncomeExpenseNet",)),
    Concept("income_tax_expense", "duration", "income_statement", False, "any", True, "best", (
        "IncomeTaxExpenseBenefit",)),
    Concept("cfo", "duration", "cash_flow", True, "any", True, "best", (
        "NetCashProvidedByUsedInOperatingActivities",
        "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    Concept("capex", "duration", "cash_flow", False, "any", True, "best", (
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    Concept("receivables", "instant", "balance_sheet", False, "any", True, "best", (
        "AccountsReceivableNetCurrent", "ReceivablesNetCurrent", "AccountsReceivableNet")),
    Concept("inventory", "instant", "balance_sheet", False, "any", True, "best", (
        "InventoryNet",)),
    Concept("current_assets", "instant", "balance_sheet", False, "any", True, "best", (
        "AssetsCurrent",)),
    Concept("total_assets", "instant", "balance_sheet", True, "any", True, "best", ("Assets",)),
    Concept("ppe_net", "instant", "balance_sheet", False, "any", True, "best", (
        "PropertyPlantAndEquipmentNet",)),
    Concept("current_liabilities", "instant", "balance_sheet", False, "any", True, "best", (
        "LiabilitiesCurrent",)),
    Concept("total_liabilities", "instant", "balance_sheet", False, "any", True, "best", (
        "Liabilities",)),
    Concept("long_term_debt", "instant", "balance_sheet", False, "any", True, "best", (
        "LongTermDebtNoncurrent", "LongTermDebt", "LongTermDebtAndCapitalLeaseObligations")),
    Concept("retained_earnings", "instant", "balance_sheet", False, "any", True, "best", (
        "RetainedEarningsAccumulatedDeficit",)),
    Concept("equity", "instant", "balance_sheet", False, "any", True, "best", (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    Concept("shares_diluted", "duration", "income_statement", False, "any", False, "best", (
        "WeightedAverageNumberOfDilutedSharesOutstanding",
        "WeightedAverageNumberOfSharesOutstandingBasic")),
)

# --- fixed values: filters and tolerances ----------------------------------------------------
TAXONOMY = "us-gaap"
ANNUAL_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A")
FOREIGN_FORMS = ("20-F", "20-F/A")
UNITS = ("USD", "shares")
MIN_FISCAL_YEAR = 2010
MIN_FILING_LAG_DAYS = 1
JANUARY_SPILL_DAYS = 10
PERIOD_CLASSES = (
    ("annual", 350, 380),
    ("quarter", 80, 100),
    ("half", 170, 195),
    ("three_quarter", 260, 285),
)
RESTATEMENT_TOLERANCE = 0.005
PRICE_TOLERANCE_DAYS = 10
HOLDING_DAYS = 365

# --- fixed values: published score weights and cut-offs --------------------------------------
BENEISH_INTERCEPT = -4.84
BENEISH_WEIGHTS = (
    ("dsri", 0.920), ("gmi", 0.528), ("aqi", 0.404), ("sgi", 0.892),
    ("depi", 0.115), ("sgai", -0.172), ("tata", 4.679), ("lvgi", -0.327),
)
BENEISH_CUTOFF = -1.78
ALTMAN_WEIGHTS = (("x1", 1.2), ("x2", 1.4), ("x3", 3.3), ("x4", 0.6), ("x5", 1.0))
ALTMAN_SAFE_ABOVE = 2.99
ALTMAN_GREY_FROM = 1.81
PIOTROSKI_STRONG_FROM = 8
PIOTROSKI_WEAK_TO = 2
AQI_ELEVATED_ABOVE = 1.5
TATA_ELEVATED_ABOVE = 0.05

# --- fixed values: plausible ranges for the quality checks -----------------------------------
PLAUSIBLE = {"m_score": (-50.0, 150.0), "z_score": (-50.0, 500.0),
             "fwd_return_12m": (-1.0, 10.0)}

# --- fixed values: named company lists -------------------------------------------------------
BASELINE_TICKERS = (
    "AAPL", "MSFT", "JNJ", "PG", "KO", "WMT", "HD", "MRK",
    "PEP", "CSCO", "ORCL", "ADBE", "TXN", "HON", "UNP", "LMT",
)
CASE_STUDIES = (
    ("LKNCY", "Luckin Coffee — fabricated revenue, disclosed 2020"),
    ("UAA", "Under Armour — SEC charges over pull-forward sales"),
    ("KHC", "Kraft Heinz — SEC action over procurement accounting"),
    ("HTZ", "Hertz — 2015 multi-year restatement"),
    ("BHC", "Bausch Health (ex-Valeant) — 2015-16 accounting controversy"),
    ("NKLA", "Nikola — SEC settlement over misleading statements"),
    ("WFC", "Wells Fargo — sales-practice scandal"),
    ("GE", "General Electric — SEC action over insurance/power disclosures"),
)
# ticker, as-of date, date the matter became public
PRE_DISCLOSURE_DATES = (
    ("UAA", "2016-02-25", "2019-11-03"),
    ("KHC", "2018-02-19", "2019-02-21"),
    ("BHC", "2015-02-28", "2015-10-15"),
    ("GE", "2017-02-27", "2019-08-15"),
    ("HTZ", "2020-02-28", "2020-05-22"),
    ("WFC", "2016-02-27", "2016-09-08"),
    ("LKNCY", "2020-04-05", "2020-04-02"),
)
FULL_HISTORY_DATE = "2099-01-01"

# --- fixed values: screener page -------------------------------------------------------------
PAGE_ROWS = 50
HISTOGRAM_BINS = 20
HISTOGRAM_CLIP = (0.05, 0.95)
F_SCORE_BINS = 10
NO_SECTOR = "(no sector data)"

SUMMED_CONCEPTS = tuple(c.concept for c in CONCEPTS if c.combine == "sum")

# --- fixed values: label texts of the screener ------------------------------------------------
SPAN_LABEL = "FY %d–%d"
SHARE_LABEL = "%d%% of screened fleet"
LEAD_LABEL = "%.1f years before it became public"
SPOTLIGHT_TITLE = "%s (%s) — flagged %s, %s"
TITLE_DATE = "MMM d, yyyy"
ELEVATED, NORMAL = "Elevated", "Normal"
