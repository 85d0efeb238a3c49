"""Exact money arithmetic and guarded division."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
TOTAL = "decimal(14,2)"
MEAN = "decimal(10,2)"
SCORE = "decimal(5,2)"
RATE = "decimal(10,4)"


def cents(value: Column) -> Column:
    """A money amount as whole cents.

    Sums of cents are exact and run on plain longs; sums of decimal(12,2) would
    carry 22-digit decimals through every aggregation buffer.
    """
    return (value.cast(MONEY) * 100).cast("long")


def from_cents(total: Column, as_type: str) -> Column:
    return (total.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(as_type)


def money_sum(value: Column, as_type: str) -> Column:
    """Aggregate: exact sum of a money column."""
    return from_cents(F.sum(cents(value)), as_type)


def money_mean(value: Column, as_type: str, places: int = 2) -> Column:
    """Aggregate: mean of the non-NULL amounts of a money column, rounded once."""
    return mean_of(F.sum(cents(value)), F.count(value), as_type, True, places)


def whole_mean(value: Column, as_type: str) -> Column:
    """Aggregate: mean of the non-NULL values of a whole-number column, rounded once."""
    return mean_of(F.sum(value), F.count(value), as_type)


def mean_of(
    total: Column, n: Column, as_type: str, hundredths: bool = False, places: int = 2
) -> Column:
    """``total / n`` to ``places`` decimals, rounded half away from zero exactly once.

    Spark's own decimal average keeps 4 extra digits, which is a second rounding
    and can be a cent off for large groups.  This divides whole units of the last
    place, so it holds for any group size.  ``total`` has at most two decimals, or
    is in hundredths already.  NULL if ``n`` is 0.
    """
    n = F.nullif(n, F.lit(0)).cast("decimal(20,0)")
    units = 10 ** (places - 2) if hundredths else 10**places
    size = (F.abs(total) * F.lit(units)).cast("decimal(38,0)")
    rounded = F.call_function("div", size * 2 + n, n * 2)
    signed = F.when(total < 0, -rounded).otherwise(rounded).cast("decimal(20,0)")
    return (signed * F.lit(Decimal(1).scaleb(-places))).cast(as_type)


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` to four places, NULL for an empty whole."""
    return F.round(
        part.cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)"), 4
    ).cast(RATE)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """Plain ratio as double; 0 where the denominator is not positive or missing."""
    num, den = part.cast("double"), whole.cast("double")
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def lenient_double(value: Column) -> Column:
    """A number where the value reads as one, NULL where it does not."""
    return value.try_cast("double")


def amount_total(value: Column) -> Column:
    """Aggregate: exact sum of a model-made double amount, to the cent."""
    return F.round(F.sum(value.cast("decimal(28,12)")), 2).cast("decimal(28,2)")


def amount_mean(value: Column) -> Column:
    """Aggregate: mean of a model-made double amount, to the cent, rounded once.

    The amounts are taken to 12 places and summed exactly; their mean is rounded half
    away from zero in whole units.
    """
    total = F.sum(value.cast("decimal(28,12)"))
    n = F.nullif(F.count(value), F.lit(0)).cast("decimal(20,0)")
    size = (F.abs(total) * F.lit(Decimal(10**12))).cast("decimal(38,0)")
    step = (n * F.lit(Decimal(10**10))).cast("decimal(38,0)")  # one cent, n times
    cent = F.call_function("div", size * 2 + step, step * 2)
    signed = F.when(total < 0, -cent).otherwise(cent).cast("decimal(28,0)")
    return (signed * F.lit(Decimal("0.01"))).cast("decimal(28,2)")
