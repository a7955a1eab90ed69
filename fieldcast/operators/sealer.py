"""Sealer decision: what fell in the last 24 hours, what comes in the next 24, and the coldest of the next 12."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import labels as L
from ..functions.numeric import fixed, whole
from ..functions.times import seconds_since_1970
from .hours import SITE, first_rows, for_sites, known_rain, last_24h, score_sealer, upcoming
from .ordered import BLOCK_ROWS, block_window, blocks, core_rows, number_rows

CURRENT = ["temp_f", "humidity_pct", "dewpoint_f", "wind_mph"]


def _trusted(rows: dict[str, Column]) -> dict[str, Column]:
    """Coverage rules: a reading with material gaps is unknown, unless what is known already decides."""
    zero = F.lit(0).cast("decimal(12,6)")
    total = F.coalesce(rows["rain"], zero)
    covered = (rows["recent"] >= R.HISTORY_MIN_ROWS) & (rows["known"] >= rows["recent"] - R.HISTORY_MAX_UNKNOWN)
    wet = total >= F.lit(R.WET_RAIN).cast("decimal(12,6)")
    prob, low = rows["prob"], rows["low"]
    return {
        "rain_last_24h": F.when(covered | wet, total).cast("double"),
        "prob_next_24h": F.when((rows["probs"] >= R.PROB_MIN_ROWS) | (prob >= R.SEALER_PROB_YELLOW), prob),
        "low_next_12h": F.when((rows["temps"] >= R.CURE_TEMP_MIN_ROWS) | (low < R.TEMP_GREEN_LOW), low),
    }


def site_inputs(history: DataFrame, forecast: DataFrame, as_of: datetime, sites: DataFrame | None = None) -> DataFrame:
    """One row per site with the current reading and the trusted 24h/24h/12h inputs; all NULL for one of ``sites``
    without any row."""
    current = F.max_by(F.struct(*CURRENT), "time")
    past = last_24h(history, as_of).groupBy(SITE).agg(
        F.count(F.lit(1)).alias("recent"),
        F.count("precip_in").alias("known"),
        F.sum(known_rain()).alias("rain"),
        F.min("temp_f").alias("temp_low_f"),
        F.max("temp_f").alias("temp_high_f"),
        F.max("humidity_pct").alias("max_humidity_pct"),
        current.alias("now"),
    )
    soon = F.col("_place") <= 12
    ahead = first_rows(upcoming(forecast, as_of), 24).groupBy(SITE).agg(
        F.count("precip_prob_pct").alias("probs"),
        F.max("precip_prob_pct").alias("prob"),
        F.count(F.when(soon, F.col("temp_f"))).alias("temps"),
        F.min(F.when(soon, F.col("temp_f"))).alias("low"),
    )
    joined = for_sites(past.join(ahead, SITE, "full"), sites)
    number = lambda n: F.coalesce(F.col(n), F.lit(0))
    rows = {n: F.col(n) for n in ("rain", "prob", "low")} | {n: number(n) for n in ("recent", "known", "probs", "temps")}
    trusted = _trusted(rows)
    return joined.select(
        SITE,
        *[F.col(f"now.{n}").alias(n) for n in CURRENT],
        *[c.alias(n) for n, c in trusted.items()],
        "temp_low_f", "temp_high_f", "max_humidity_pct",
    )


def rolling_site_inputs(hours: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same inputs with every hour of the table taken as "now".

    The past is a span of time, so its frame is cut by time: a day of a site with the whole day before it, however many
    readings these hold. What lies ahead is a number of rows, and its frame is cut into blocks of rows."""
    day = F.col("time").cast("date")
    seconds = seconds_since_1970(hours, "time")
    halo = F.inline(F.array(F.struct(day.alias("_day"), F.lit(True).alias("_own")), F.struct(F.date_add(day, 1).alias("_day"), F.lit(False).alias("_own"))))
    past = Window.partitionBy(SITE, "_day").orderBy("_sec").rangeBetween(-86400, 0)
    ahead = block_window([SITE], "_sec").rowsBetween(0, 23)
    soon = block_window([SITE], "_sec").rowsBetween(0, 11)
    behind = hours.withColumn("_sec", seconds).select("*", halo).withColumns(
        {
            "recent": F.count(F.lit(1)).over(past),
            "known": F.count("precip_in").over(past),
            "rain": F.sum(known_rain()).over(past),
            "temp_low_f": F.min("temp_f").over(past),
            "temp_high_f": F.max("temp_f").over(past),
            "max_humidity_pct": F.max("humidity_pct").over(past),
        }
    )
    numbered = number_rows(behind.filter("_own").drop("_own", "_day"), [SITE], ["time"], day)
    framed = blocks(numbered, before=0, after=23, block_rows=block_rows).withColumns(
        {
            "probs": F.count("precip_prob_pct").over(ahead),
            "prob": F.max("precip_prob_pct").over(ahead),
            "temps": F.count("temp_f").over(soon),
            "low": F.min("temp_f").over(soon),
        }
    )
    names = ["rain", "prob", "low", "recent", "known", "probs", "temps"]
    trusted = _trusted({n: F.col(n) for n in names})
    return core_rows(framed).select(
        SITE, "time", *CURRENT, *[c.alias(n) for n, c in trusted.items()],
        "temp_low_f", "temp_high_f", "max_humidity_pct",
    )


def sealer_reasons() -> Column:
    """Why the sealer verdict is not green, in the fixed order of the checks."""
    c = F.col
    grade = lambda name: c("sealer_factors")[name]
    bad = lambda name: grade(name).isin("red", "yellow")
    word = lambda name, red, yellow: F.when(grade(name) == "red", red).otherwise(yellow)
    rain = fixed(c("rain_last_24h"), 2)
    known = c("rain_last_24h").isNotNull()
    last = (
        F.when((grade("rain_last_24h") == "red") & known,
               F.concat(rain, F.lit('" rain in last 24h — slab needs to dry')))
        .when(grade("rain_last_24h") == "red", "Rain in last 24h — slab needs to dry")
        .when((grade("rain_last_24h") == "yellow") & known,
              F.concat(F.lit("Trace rain in last 24h ("), rain, F.lit('") — check the slab is dry')))
        .when(grade("rain_last_24h") == "yellow", "Trace rain in last 24h — check the slab")
    )
    said = lambda name, red, yellow, value, tail: F.when(
        bad(name) & value.isNotNull(), F.concat(word(name, red, yellow), F.lit(" — "), whole(value), F.lit(tail))
    )
    spread = c("temp_f") - c("dewpoint_f")
    lines = F.array(
        last,
        F.when(
            bad("rain_next_24h") & c("prob_next_24h").isNotNull(),
            F.concat(word("rain_next_24h", "Rain likely", "Rain possible"), F.lit(" in next 24h — "),
                     whole(c("prob_next_24h")), F.lit("% chance")),
        ),
        F.when(
            bad("cure_temp") & c("low_next_12h").isNotNull(),
            F.concat(word("cure_temp", "Too cold overnight", "Cool overnight"), F.lit(" — dropping to "),
                     whole(c("low_next_12h")), F.lit("°F while it cures")),
        ),
        said("temperature", "Too cold to apply", "Cold to apply", c("temp_f"), "°F right now"),
        said("wind", "Too windy", "Breezy", c("wind_mph"), "mph (overspray and debris)"),
        said("humidity", "Too humid", "Humid", c("humidity_pct"), "% (slow cure)"),
        F.when(
            bad("dewpoint") & spread.isNotNull(),
            F.concat(F.lit("Dew point within "), whole(spread), F.lit("°F of air temp — condensation risk")),
        ),
        F.when(grade("data") == "yellow", "Some readings unavailable — verdict capped at caution"),
    )
    return F.array_compact(lines)


def sealer_details() -> Column:
    """The readings behind the verdict as short lines."""
    c = F.col
    line = lambda value, head, tail, digits=0: F.when(
        value.isNotNull(), F.concat(F.lit(head), fixed(value, digits), F.lit(tail))
    )
    rain = c("rain_last_24h")
    return F.array_compact(
        F.array(
            F.when(rain.isNull(), "Rain in last 24h: unknown (missing data)")
            .when(rain == 0, "No rain in last 24h")
            .otherwise(F.concat(F.lit("Rain in last 24h: "), fixed(rain, 2), F.lit(" in"))),
            F.when(
                c("temp_low_f").isNotNull(),
                F.concat(F.lit("Temp range: "), whole(c("temp_low_f")), F.lit("-"), whole(c("temp_high_f")), F.lit("°F")),
            ),
            line(c("humidity_pct"), "Current humidity: ", "%"),
            line(c("wind_mph"), "Current wind: ", " mph"),
            line(c("low_next_12h"), "Low next 12h: ", "°F"),
            line(c("prob_next_24h"), "Max rain chance next 24h: ", "%"),
            line(c("temp_f") - c("dewpoint_f"), "Dew point spread: ", "°F", 1),
        )
    )


def explain(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            "verdict": L.sealer_verdict_text(F.col("sealer_score")),
            "reasons": sealer_reasons(),
            "details": sealer_details(),
        }
    )


def sealer_check(history: DataFrame, forecast: DataFrame, as_of: datetime, sites: DataFrame | None = None) -> DataFrame:
    """One decision row per site; one of ``sites`` without any row has no score and the no-data verdict."""
    return explain(score_sealer(site_inputs(history, forecast, as_of, sites)))
