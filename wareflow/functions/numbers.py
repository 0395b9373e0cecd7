"""Guarded division and rounding that does not depend on how the data is partitioned."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Counts, units and money: exact to the cent, and their quotient to 18 digits.
EXACT = "decimal(20,2)"
#: The same, of totals of any size.
WIDE = "decimal(38,2)"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` of counts, units or money as a decimal, NULL when the divisor is zero."""
    return num.cast(EXACT) / F.nullif(den.cast(EXACT), F.lit(0).cast(EXACT))


def rounded(col: Column, digits: int) -> Column:
    """Round a decimal half away from zero, once."""
    return F.round(col, digits)


def steady(col: Column) -> Column:
    """A double as DECIMAL(24,6): one that differs in its last bit, because partial sums met in
    another order, still rounds to the same figure. For roots only; quotients are exact."""
    return col.cast("decimal(24,6)")


def quotient(num: Column, den: Column, digits: int = 2, times: int = 1) -> Column:
    """``num * times / den`` of counts, units or money, rounded once, half away from zero.

    Whole cents are divided as whole numbers, so the result is exact whatever the size of the total, as long as
    ``num * times`` has no more than 35 digits before and behind the rounded place together; larger ones
    raise an error. NULL when the divisor is zero.
    """
    a, b = ((x.cast(WIDE) * 100).cast("decimal(38,0)") for x in (num, den))
    twice = F.abs(a) * (2 * times * 10**digits) + F.abs(b)
    unit = F.nullif(F.abs(b) * 2, F.lit(0))
    whole = ((twice - twice % unit) / unit).cast("decimal(34,0)") * F.lit(Decimal(1).scaleb(-digits))
    return F.when((num < 0) != (den < 0), -whole).otherwise(whole)


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    return quotient(num, den, digits, 100)


def exact(value: float | str | Decimal) -> Column:
    """A decimal literal, so that thresholds such as 0.7 are compared without binary error."""
    return F.lit(Decimal(str(value)))


def std_error(deviation: Column, count: Column) -> Column:
    """Standard error of a mean as a double; NULL for an empty group."""
    return deviation / F.nullif(F.sqrt(count), F.lit(0.0))


def sample_deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from exact moments: count, sum and sum of squares. NULL below two values."""
    whole = total.cast("decimal(19,2)")
    spread = (n.cast("decimal(14,0)") * squares.cast("decimal(24,4)")).cast("decimal(38,4)") - whole * whole
    return F.when(n > 1, F.sqrt(spread.cast("double") / n / (n - 1)))
