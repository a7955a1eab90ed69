"""The 48-hour cure window after a pour."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import grading as G
from ..functions import labels as L
from ..functions.numeric import whole
from .hours import SITE, first_rows, for_sites, known_rain, upcoming
from .ordered import BLOCK_ROWS, block_window, blocks, core_rows, number_rows


def _grade(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Verdict, factors and issues from the aggregates of one window per row."""
    c = F.col
    usable = F.coalesce("low", "prob_1", "rain_1", "wind_1").isNotNull()
    rain_seen = F.coalesce("prob_1", "rain_1").isNotNull()
    prob = F.coalesce(c("prob_1"), F.lit(0.0))
    rain = F.coalesce(c("rain_1"), F.lit(0).cast("decimal(12,6)"))
    wet = F.lit(R.WET_RAIN).cast("decimal(12,6)")
    first_day = F.when(
        rain_seen,
        F.when((prob < R.CURE_PROB_GREEN) & (rain < wet), R.GREEN)
        .when(prob < R.CURE_PROB_YELLOW, R.YELLOW)
        .otherwise(R.RED),
    )
    second_day = F.coalesce(c("prob_2") >= R.CURE_PROB_YELLOW, F.lit(False)) & F.coalesce(
        c("_first_day") != R.RED, F.lit(True)
    )
    wind, gust = (
        G.below(c("wind_1"), R.CURE_WIND_GREEN, R.CURE_WIND_YELLOW),
        G.below(c("gust_1"), R.CURE_GUST_GREEN, R.CURE_GUST_YELLOW),
    )
    missing = F.array_compact(
        F.array(
            F.when(c("low").isNull(), "temperature"),
            F.when(F.col("prob_1").isNull() | F.col("rain_1").isNull(), "precipitation"),
            F.when(c("wind_1").isNull(), "wind"),
        )
    )
    heat = F.when(c("high").isNull(), None).when(c("high") <= R.TEMP_GREEN_HIGH, R.GREEN).when(
        c("high") <= R.TEMP_YELLOW_HIGH, R.YELLOW
    ).otherwise(R.RED)
    graded = (
        rows.withColumn("_usable", usable)
        .withColumn("_first_day", first_day)
        .withColumn("_second_day", second_day)
        .withColumn("_missing", missing)
        .withColumns(
            {
                "_freeze": G.at_least(c("low"), R.TEMP_GREEN_LOW, R.TEMP_YELLOW_LOW),
                "_rain": F.when(c("_second_day"), R.YELLOW).otherwise(c("_first_day")),
                "_heat": heat,
                "_wind": wind,
                "_gust": gust,
                "_data": F.when(F.size("_missing") > 0, R.YELLOW),
            }
        )
    )
    only = lambda x: F.when(c("_usable"), x)
    factors = {
        "freeze_risk": only(c("_freeze")),
        "rain_during_cure": only(c("_rain")),
        "heat_stress": only(c("_heat")),
        "wind_drying": only(F.greatest("_wind", "_gust")),
        "data": only(c("_data")),
    }
    verdict = G.label(G.worst(factors))
    return graded.select(
        *keys,
        verdict.alias("score"),
        L.cure_verdict_text(verdict).alias("verdict"),
        G.factor_map(factors).alias("factors"),
        F.when(c("_usable"), _issues()).otherwise(
            F.array(F.lit("No usable forecast data — cannot assess cure window"))
        ).alias("issues"),
        "hours",
        F.col("low").alias("temp_low_f"),
        F.col("high").alias("temp_high_f"),
    )


def _issues() -> Column:
    """Issue lines in the order of the checks."""
    c = F.col

    def line(severity: str, value: str, yellow: tuple[str, str], red: tuple[str, str]) -> Column:
        text = lambda ends: F.concat(F.lit(ends[0]), whole(c(value)), F.lit(ends[1]))
        return F.when(c(severity) == R.YELLOW, text(yellow)).when(c(severity) == R.RED, text(red))

    prob = F.coalesce(c("prob_1"), F.lit(0.0))
    return F.array_compact(
        F.array(
            line("_freeze", "low",
                 ("Temp drops to ", "°F — consider blankets/enclosures"),
                 ("Freeze risk: low of ", "°F — concrete will not cure properly")),
            F.when(
                c("_first_day") == R.YELLOW,
                F.concat(F.lit("Rain chance up to "), whole(prob), F.lit("% in first 24h — have tarps ready")),
            ).when(
                c("_first_day") == R.RED,
                F.concat(F.lit("Rain likely ("), whole(prob), F.lit("%) in first 24h — will damage fresh surface")),
            ),
            F.when(
                c("_second_day"),
                F.concat(F.lit("Rain likely in hours 24-48 ("), whole(c("prob_2")),
                         F.lit("%) — less critical but monitor")),
            ),
            line("_heat", "high",
                 ("High of ", "°F — mist cure or apply curing compound"),
                 ("Extreme heat (", "°F) — rapid moisture loss, high crack risk")),
            line("_wind", "wind_1",
                 ("Sustained wind to ", "mph — accelerates surface drying"),
                 ("High sustained wind (", "mph) — significant surface drying and crack risk")),
            line("_gust", "gust_1",
                 ("Wind gusts to ", "mph — accelerates surface drying"),
                 ("Severe wind gusts (", "mph) — high surface-drying and crack risk")),
            F.when(
                F.size("_missing") > 0,
                F.concat(F.lit("Missing forecast data ("), F.array_join("_missing", ", "),
                         F.lit(") — treat with caution")),
            ),
        )
    )


def cure_check(forecast: DataFrame, as_of: datetime, sites: DataFrame | None = None) -> DataFrame:
    """One decision row per site for a pour at ``as_of``: its first 48 upcoming rows.

    Every one of ``sites`` is answered: without upcoming rows it has no hours, no score and the no-data verdict."""
    rows = first_rows(upcoming(forecast, as_of), R.DETAIL_HOURS)
    early, late = F.col("_place") <= 24, F.col("_place") > 24
    windows = rows.groupBy(SITE).agg(
        F.count(F.lit(1)).alias("hours"),
        F.min("temp_f").alias("low"),
        F.max("temp_f").alias("high"),
        F.max(F.when(early, F.col("precip_prob_pct"))).alias("prob_1"),
        F.sum(F.when(early, known_rain())).alias("rain_1"),
        F.max(F.when(late, F.col("precip_prob_pct"))).alias("prob_2"),
        F.max(F.when(early, F.col("wind_mph"))).alias("wind_1"),
        F.max(F.when(early, F.col("wind_gust_mph"))).alias("gust_1"),
    )
    answered = for_sites(windows, sites).withColumn("hours", F.coalesce("hours", F.lit(0).cast("bigint")))
    return _grade(answered, [SITE])


def rolling_cure(hours: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same decision with every hour of the table taken as the start of the pour."""
    numbered = number_rows(hours, [SITE], ["time"], F.col("time").cast("date"))
    w = block_window([SITE])
    day_1, day_2, both = w.rowsBetween(0, 23), w.rowsBetween(24, 47), w.rowsBetween(0, 47)
    framed = blocks(numbered, before=0, after=47, block_rows=block_rows).withColumns(
        {
            "hours": F.count(F.lit(1)).over(both),
            "low": F.min("temp_f").over(both),
            "high": F.max("temp_f").over(both),
            "prob_1": F.max("precip_prob_pct").over(day_1),
            "rain_1": F.sum(known_rain()).over(day_1),
            "prob_2": F.max("precip_prob_pct").over(day_2),
            "wind_1": F.max("wind_mph").over(day_1),
            "gust_1": F.max("wind_gust_mph").over(day_1),
        }
    )
    return _grade(core_rows(framed), [SITE, "time"])
