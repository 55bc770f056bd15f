"""The three published scores as SQL expressions over one wide company-year row.

A row holds this fiscal year's figures as plain columns and the year before as the struct
``previous``. Every expression is null when one of its inputs is missing or a divisor is zero.
"""

from __future__ import annotations

from .. import fixed


def ratio(top: str, bottom: str) -> str:
    return f"try_divide({top}, {bottom})"


def before(name: str) -> str:
    return f"previous.{name}"


def _now(name: str) -> str:
    return name


def _share(year, item: str, whole: str) -> str:
    return ratio(year(item), year(whole))


def _soft_assets(year) -> str:
    hard = f"{year('current_assets')} + {year('ppe_net')}"
    return f"1 - {ratio(hard, year('total_assets'))}"


def _depreciation_rate(year) -> str:
    spent = year("depreciation_amortisation")
    return ratio(spent, f"{spent} + {year('ppe_net')}")


def _change(item: str, whole: str) -> str:
    return ratio(_share(_now, item, whole), _share(before, item, whole))


def beneish_indices() -> dict[str, str]:
    return {
        "dsri": _change("receivables", "revenue"),
        "gmi": ratio(_share(before, "gross_profit", "revenue"),
                     _share(_now, "gross_profit", "revenue")),
        "aqi": ratio(_soft_assets(_now), _soft_assets(before)),
        "sgi": ratio("revenue", before("revenue")),
        "depi": ratio(_depreciation_rate(before), _depreciation_rate(_now)),
        "sgai": _change("sga", "revenue"),
        "tata": ratio("net_income - cfo", "total_assets"),
        "lvgi": _change("total_liabilities", "total_assets"),
    }


def m_score() -> str:
    """Weighted sum, left to right, rounded to three places."""
    terms = [f"{weight}D * {name}" for name, weight in fixed.BENEISH_WEIGHTS]
    return f"round({' + '.join([f'{fixed.BENEISH_INTERCEPT}D', *terms])}, 3)"


def altman_factors() -> dict[str, str]:
    return {
        "x1": ratio("current_assets - current_liabilities", "total_assets"),
        "x2": ratio("retained_earnings", "total_assets"),
        "x3": ratio("operating_income", "total_assets"),
        "x4": ratio("market_value_of_equity", "total_liabilities"),
        "x5": ratio("revenue", "total_assets"),
    }


def altman_sum() -> str:
    return " + ".join(f"{weight}D * {name}" for name, weight in fixed.ALTMAN_WEIGHTS)


def altman_zone(total: str) -> str:
    """Zone from the unrounded sum; null stays null."""
    return (f"case when {total} > {fixed.ALTMAN_SAFE_ABOVE}D then 'safe' "
            f"when {total} >= {fixed.ALTMAN_GREY_FROM}D then 'grey' "
            f"when {total} is not null then 'distress' end")


def piotroski_signals(shares: str = "shares") -> dict[str, str]:
    """Nine 0/1 signals; a comparison with a null side casts to null, never to 0."""
    def moved(item: str, whole: str, sign: str = ">") -> str:
        return f"{_share(_now, item, whole)} {sign} {_share(before, item, whole)}"

    tests = {
        "positive_roa": "net_income > 0",
        "positive_cfo": "cfo > 0",
        "roa_improved": moved("net_income", "total_assets"),
        "earnings_quality": "cfo > net_income",
        "leverage_decreased": moved("long_term_debt", "total_assets", "<"),
        "liquidity_improved": moved("current_assets", "current_liabilities"),
        "no_dilution": f"{shares} <= {before(shares)}",
        "margin_improved": moved("gross_profit", "revenue"),
        "turnover_improved": moved("revenue", "total_assets"),
    }
    return {name: f"cast({test} as int)" for name, test in tests.items()}


def piotroski_band(score: str) -> str:
    return (f"case when {score} >= {fixed.PIOTROSKI_STRONG_FROM} then 'strong' "
            f"when {score} <= {fixed.PIOTROSKI_WEAK_TO} then 'weak' "
            f"when {score} is not null then 'neutral' end")


def missing(names: tuple[str, ...], prefix: str = "") -> str:
    """Array with the names of the columns that are null, in the given order."""
    marks = ", ".join(f"if({prefix}{n} is null, '{n}', null)" for n in names)
    return f"array_compact(array({marks}))"
