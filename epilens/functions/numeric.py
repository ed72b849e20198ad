"""Numbers that come out alike in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio2(top: str, bottom: str) -> Column:
    """top / bottom to two decimals, half to even, in integer arithmetic; 0 where bottom is 0 or null.

    Both are SQL expressions of whole numbers, bottom not negative.
    """
    x = f"(100 * cast({top} as bigint))"
    n = f"nullif(cast({bottom} as bigint), 0)"
    rest = f"pmod({x}, {n})"
    q = f"(({x} - {rest}) div {n})"
    return F.expr(f"coalesce(({q} + case when 2 * {rest} > {n} or (2 * {rest} = {n} and pmod({q}, 2) = 1) then 1 else 0 end) / 100.0D, 0.0D)")


def growth2(now: str, before: str) -> Column:
    """Percent growth: 100 if there was nothing before and is now, else 0 without a past."""
    return F.when(F.expr(f"{before} <= 0"), F.when(F.expr(f"{now} > 0"), 100.0).otherwise(0.0)).otherwise(ratio2(f"(100 * ({now} - {before}))", before))


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(*rules: tuple[str, object], default: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(F.expr(condition), value) if out is None else out.when(F.expr(condition), value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def risk_class(high: str, average: str, n: str, steps: tuple[int, int, int] = (70, 50, 35)) -> Column:
    """HIGH, MEDIUM_HIGH, MEDIUM or LOW from counts of high scores, the average and the number of signals."""
    a, b, c = steps
    return ladder((f"{high} >= 3 or {average} >= {a}", "HIGH"), (f"{high} >= 1 or {average} >= {b}", "MEDIUM_HIGH"), (f"{average} >= {c} or {n} >= 3", "MEDIUM"), default="LOW")
