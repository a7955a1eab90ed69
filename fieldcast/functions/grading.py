"""Verdicts as column expressions: every factor is a severity 1..3 or NULL, the worst one decides.

A NULL input means "no data" and never improves a verdict: when any core input is missing a ``data``
factor at yellow is added, and with no usable input at all the verdict is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R

Factors = dict[str, Column]


def label(severity: Column) -> Column:
    """One reference to ``severity``: a verdict is long, and filters on it are copied into the scan."""
    return F.get(F.lit(list(R.VERDICTS)), severity - 1)


def severity_of(verdict: Column) -> Column:
    return F.when(verdict == "green", R.GREEN).when(verdict == "yellow", R.YELLOW).when(verdict == "red", R.RED)


def banded(x: Column, green: Column, yellow: Column) -> Column:
    return F.when(x.isNull(), None).when(green, R.GREEN).when(yellow, R.YELLOW).otherwise(R.RED)


def below(x: Column, green, yellow) -> Column:
    """Green under the first limit, yellow under the second, red from there on."""
    return F.when(x < green, R.GREEN).when(x < yellow, R.YELLOW).when(x >= yellow, R.RED)


def at_least(x: Column, green, yellow) -> Column:
    return F.when(x >= green, R.GREEN).when(x >= yellow, R.YELLOW).when(x < yellow, R.RED)


def above(x: Column, green, yellow) -> Column:
    return F.when(x > green, R.GREEN).when(x > yellow, R.YELLOW).when(x <= yellow, R.RED)


def within(x: Column, green_low, green_high, yellow_low, yellow_high) -> Column:
    return banded(x, x.between(green_low, green_high), x.between(yellow_low, yellow_high))


def working_temperature(t: Column) -> Column:
    return within(t, R.TEMP_GREEN_LOW, R.TEMP_GREEN_HIGH, R.TEMP_YELLOW_LOW, R.TEMP_YELLOW_HIGH)


def any_null(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def any_known(*cols: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.isNotNull() for c in cols])


def data_factor(usable: Column, *core: Column) -> Column:
    """Yellow when something could be graded (``usable``) and a core input is missing."""
    return F.when(usable & any_null(*core), R.YELLOW)


def worst(factors: Factors) -> Column:
    return F.greatest(*factors.values())


def factor_map(factors: Factors) -> Column:
    """map<factor, verdict> of the factors that are present."""
    pairs = [item for name, sev in factors.items() for item in (F.lit(name), label(sev))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def factor_text(factors: Column) -> Column:
    """A factor map as sorted ``name=verdict`` text, for flat sinks."""
    pairs = F.transform(F.map_entries(factors), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "|")


# --- the four graders ------------------------------------------------------------------------


def daily_pour_factors(high: Column, rain: Column, wind: Column) -> Factors:
    return {
        "temperature": working_temperature(high),
        "precipitation": banded(rain, rain == 0, rain < F.lit(R.DAILY_POUR_RAIN_YELLOW).cast("decimal(5,2)")),
        "wind": below(wind, R.POUR_WIND_GREEN, R.POUR_WIND_YELLOW),
        # wind is sparse in old archives, so its absence alone does not cap a day
        "data": data_factor(any_known(high, rain, wind), high, rain),
    }


def daily_sealer_factors(high: Column, low: Column, rain: Column) -> Factors:
    both = F.when(any_null(high, low), None)
    temperature = (
        both.when((low >= R.TEMP_GREEN_LOW) & (high <= R.TEMP_GREEN_HIGH), R.GREEN)
        .when(low >= R.TEMP_YELLOW_LOW, R.YELLOW)
        .otherwise(R.RED)
    )
    return {
        "precipitation": banded(rain, rain == 0, rain < F.lit(R.DAILY_SEALER_RAIN_YELLOW).cast("decimal(5,2)")),
        "temperature": temperature,
        "data": data_factor(rain.isNotNull() | (high.isNotNull() & low.isNotNull()), rain, high, low),
    }


def dewpoint_spread(temp: Column, dewpoint: Column) -> Column:
    return above(temp - dewpoint, R.SPREAD_GREEN, R.SPREAD_YELLOW)


def hourly_pour_factors(
    temp: Column, humidity: Column, wind: Column, prob: Column, dewpoint: Column
) -> Factors:
    humid = within(
        humidity,
        R.POUR_HUMIDITY_GREEN_LOW,
        R.POUR_HUMIDITY_GREEN_HIGH,
        R.POUR_HUMIDITY_YELLOW_LOW,
        R.POUR_HUMIDITY_YELLOW_HIGH,
    )
    core = (temp, humidity, wind, prob)
    return {
        "temperature": working_temperature(temp),
        "humidity": humid,
        "wind": below(wind, R.POUR_WIND_GREEN, R.POUR_WIND_YELLOW),
        "precipitation": below(prob, R.POUR_PROB_GREEN, R.POUR_PROB_YELLOW),
        "dewpoint": dewpoint_spread(temp, dewpoint),
        "data": data_factor(any_known(*core), *core),
    }


def hourly_sealer_factors(
    temp: Column,
    humidity: Column,
    rain_last_24h: Column,
    prob_next_24h: Column,
    dewpoint: Column,
    wind: Column,
    low_next_12h: Column,
) -> Factors:
    no_hot_band = banded(temp, temp.between(R.TEMP_GREEN_LOW, R.TEMP_GREEN_HIGH),
                         (temp >= R.TEMP_YELLOW_LOW) & (temp < R.TEMP_GREEN_LOW))
    core = (temp, humidity, rain_last_24h, prob_next_24h, wind, low_next_12h)
    return {
        "temperature": no_hot_band,
        "cure_temp": at_least(low_next_12h, R.TEMP_GREEN_LOW, R.TEMP_YELLOW_LOW),
        "wind": below(wind, R.SEALER_WIND_GREEN, R.SEALER_WIND_YELLOW),
        "humidity": below(humidity, R.SEALER_HUMIDITY_GREEN, R.SEALER_HUMIDITY_YELLOW),
        "rain_last_24h": below(rain_last_24h, float(R.TRACE_RAIN), float(R.WET_RAIN)),
        "rain_next_24h": below(prob_next_24h, R.SEALER_PROB_GREEN, R.SEALER_PROB_YELLOW),
        "dewpoint": dewpoint_spread(temp, dewpoint),
        "data": data_factor(any_known(*core), *core),
    }
