"""Plain-language reasons why a working day is not clear, worst factor first."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import labels as L
from ..functions.numeric import whole
from .hours import SITE, best_windows, by_day, detail_dates, score_pour, upcoming, verdict_aggregates, working

NO_DATA = "No forecast data for working hours — treat as no-go"


# What each factor needs to know about the hours it misbehaves: name -> aggregate.
_MEASURED = {
    "precipitation": {"prob": "max(precip_prob_pct)"},
    "temperature": {"low": "min(temp_f)", "high": "max(temp_f)"},
    "wind": {"peak": "max(wind_mph)"},
    "humidity": {"humid": "max(humidity_pct)", "dry": "min(humidity_pct)"},
    "dewpoint": {"spread": "min(temp_f - dewpoint_f)"},
    "data": {},
}


def _factor_aggregates(start: int, end: int) -> list[Column]:
    """Per factor and grade the hours as a bit set and the measures over them: plain numeric aggregates, so a day
    is one hash aggregation without exploding its factors."""
    out = []
    for factor, measured in _MEASURED.items():
        for grade in ("red", "yellow"):
            bad = f"filter (where hour >= {start} and hour < {end} and pour_factors['{factor}'] = '{grade}')"
            out.append(F.expr(f"bit_or(shiftleft(1, cast(hour as int))) {bad} as {factor}_{grade}"))
            out += [F.expr(f"{measure} {bad} as {factor}_{grade}_{name}") for name, measure in measured.items()]
    return out


def _sentences() -> dict[str, Column]:
    """One sentence per factor from the measures of its worst grade and the span of hours."""
    c = F.col

    def red(factor: str, yes: str, no: str) -> Column:
        return F.when(c(f"{factor}_is_red"), yes).otherwise(no)

    def said(factor: str, head: Column, name: str, unit: str) -> Column:
        return F.concat(head, F.lit(" — "), whole(c(f"{factor}_{name}")), F.lit(unit), c(f"{factor}_span"))

    def plain(factor: str, head: str) -> Column:
        return F.concat(F.lit(head), c(f"{factor}_span"))

    unknown = lambda factor, name: c(f"{factor}_{name}").isNull()
    rain, temp, wind, hum, dew = "precipitation", "temperature", "wind", "humidity", "dewpoint"
    return {
        rain: F.when(unknown(rain, "prob"), plain(rain, "Rain risk ")).otherwise(
            said(rain, red(rain, "Rain likely", "Rain possible"), "prob", "% chance ")
        ),
        temp: F.when(unknown(temp, "low"), plain(temp, "Temperature out of range "))
        .when(c("temperature_low") < R.TEMP_GREEN_LOW, said(temp, red(temp, "Too cold", "Cold"), "low", "°F "))
        .otherwise(said(temp, red(temp, "Too hot", "Hot"), "high", "°F ")),
        wind: F.when(unknown(wind, "peak"), plain(wind, "Windy ")).otherwise(
            said(wind, red(wind, "High wind", "Breezy"), "peak", "mph ")
        ),
        hum: F.when(unknown(hum, "humid"), plain(hum, "Humidity out of range "))
        .when(c("humidity_humid") > R.POUR_HUMIDITY_GREEN_HIGH, said(hum, F.lit("Humid"), "humid", "% "))
        .otherwise(F.concat(said(hum, F.lit("Very dry air"), "dry", "% "), F.lit(" (surface may crust)"))),
        dew: F.when(unknown(dew, "spread"), plain(dew, "Narrow dew point spread ")).otherwise(
            F.concat(F.lit("Dew point within "), whole(c("dewpoint_spread")), F.lit("°F of air temp "),
                     c("dewpoint_span"), F.lit(" — slow drying"))
        ),
        "data": plain("data", "Missing forecast data "),
    }


def day_profile(
    days: DataFrame, start: int = R.WORK_START_HOUR, end: int = R.WORK_END_HOUR
) -> DataFrame:
    """Verdict columns and ``reasons`` of every site-day in one aggregation.

    A factor speaks about its red hours if it has any, else about its yellow ones; reds come first, then the fixed
    factor order.
    """
    kept = [SITE, "date", "score", "temp_high_f", "temp_low_f", "working_hours", "unscored_hours"]
    summed = days.groupBy(SITE, "date").agg(*verdict_aggregates(start, end), *_factor_aggregates(start, end))
    chosen = []
    for factor, measured in _MEASURED.items():
        worst = lambda tail: f"if({factor}_red is not null, {factor}_red{tail}, {factor}_yellow{tail})"  # noqa: E731, B023
        chosen += [
            F.expr(f"{factor}_red is not null as {factor}_is_red"),
            F.expr(f"filter(sequence({start}, {end - 1}), h -> getbit({worst('')}, h) = 1) as {factor}_hours"),
            *[F.expr(f"{worst('_' + name)} as {factor}_{name}") for name in measured],
        ]
    measured_days = summed.select(*kept, *chosen)
    spans = {f"{factor}_span": L.span_phrase(f"{factor}_hours", start, end) for factor in _MEASURED}
    sentences = _sentences()
    lines = F.array(
        *[
            F.when(
                F.size(f"{factor}_hours") > 0,
                F.struct(
                    F.when(F.col(f"{factor}_is_red"), 0).otherwise(1).alias("s"),
                    F.lit(rank).alias("r"),
                    sentences[factor].alias("text"),
                ),
            )
            for rank, factor in enumerate(R.FACTOR_ORDER)
        ]
    )
    told = measured_days.withColumns(spans).select(
        *kept, F.transform(F.array_sort(F.array_compact(lines)), lambda x: x["text"]).alias("reasons")
    )
    return told.withColumn("reasons", complete_reasons())


def complete_reasons() -> Column:
    """Adds the no-data line and the count of unscored hours to the factor reasons."""
    reasons = F.col("reasons")
    unscored = F.col("unscored_hours")
    gap = F.concat(F.lit("Missing data for "), unscored.cast("string"), F.lit(" working hour(s)"))
    tell = (unscored > 0) & ~F.exists(reasons, lambda r: r.startswith("Missing"))
    return F.when(
        F.col("working_hours") == unscored, F.array(F.lit(NO_DATA))
    ).otherwise(F.when(tell, F.array_append(reasons, gap)).otherwise(reasons))


def day_summaries(forecast: DataFrame, as_of: datetime) -> DataFrame:
    """Verdict, reasons, temperatures and best window for every upcoming day of every site."""
    hours = upcoming(forecast, as_of)
    days = by_day(score_pour(hours))
    today = F.lit(date(as_of.year, as_of.month, as_of.day))
    detail = detail_dates(hours, as_of).withColumn("_detail", F.lit(True))
    return (
        day_profile(days)
        .join(best_windows(days), [SITE, "date"], "left")
        .join(detail, [SITE, "date"], "left")
        .select(
            SITE, "date",
            L.day_label(F.col("date"), today).alias("label"),
            "score",
            "reasons",
            "temp_high_f", "temp_low_f", "best_window", "best_window_label", "window_hours",
            F.col("_detail").isNull().alias("outlook"),
        )
    )
