"""Sums of amounts that come out the same in whatever order their parts are met."""

from __future__ import annotations

#: Digits after the point that a summed amount keeps; it has room for 28 before it.
SCALE = 10
_AMOUNT = f"decimal(38, {SCALE})"


def exact_sum(value: str) -> str:
    """SQL of an aggregate: the sum of a double column, added up as decimals.

    Every amount counts as the shortest decimal that names it, to ten digits after the point, so
    the sum is exact and merges in any order; it becomes a double once, at the end. Null amounts
    do not count. Where an amount or the sum has more than 28 digits before the point, the doubles
    are added up instead.
    """
    amount = f"try_cast({value} as {_AMOUNT})"
    return (f"if(count({amount}) = count({value}), "
            f"coalesce(cast(try_sum({amount}) as double), sum({value})), sum({value}))")
