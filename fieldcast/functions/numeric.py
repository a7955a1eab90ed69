"""Rounding and formatting, exact to the last digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """``x`` as text with ``digits`` decimals, ties decided on the exact binary value (half-even)."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def whole(x: Column) -> Column:
    return fixed(x, 0)


def exact_avg(x: Column, digits: int) -> Column:
    """Average of a decimal column, exact before it is rounded half away from zero."""
    return F.round(F.sum(x) / F.count(x), digits)


def percent(part: Column, total: Column, digits: int = 1) -> Column:
    """100 * part / total over integer counts, NULL when total is 0."""
    return F.round(
        (part.cast("decimal(18,0)") * 100) / F.nullif(total.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")),
        digits,
    )


def tenths(x: Column) -> Column:
    """A one-decimal measure as a whole number of tenths, for exact integer arithmetic."""
    return (x.cast("decimal(12,1)") * 10).cast("bigint")
