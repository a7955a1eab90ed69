"""Archive units to working units, in decimal arithmetic so no binary noise reaches a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import fixed


def _scaled(v: Column, times: int, over: int, digits: int, precision: int) -> Column:
    exact = (v.cast("decimal(9,0)") * times) / F.lit(over).cast("decimal(9,0)")
    return F.round(exact, digits).cast(f"decimal({precision},{digits})")


def fahrenheit_from_tenths_c(v: Column) -> Column:
    exact = (v.cast("decimal(9,0)") * 18 + 3200) / F.lit(100).cast("decimal(9,0)")
    return F.round(exact, 1).cast("decimal(5,1)")


def inches_from_tenths_mm(v: Column) -> Column:
    return _scaled(v, 1, 254, 2, 5)


def inches_from_mm(v: Column) -> Column:
    return _scaled(v, 10, 254, 1, 5)


def mph_from_tenths_ms(v: Column) -> Column:
    return _scaled(v, 2237, 10000, 1, 5)


def mean_temperature(high: Column, low: Column) -> Column:
    """Midpoint to one decimal. Every odd sum is a tie, and ties follow the binary value."""
    middle = (high.cast("double") + low.cast("double")) / 2
    return fixed(middle, 1).cast("decimal(5,1)")


def observed_gust(fastest_2min: Column, fastest_5sec: Column) -> Column:
    return F.coalesce(fastest_2min, fastest_5sec)
