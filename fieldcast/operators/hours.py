"""Hourly readings: time slices, hourly verdicts, day verdicts, best windows.

An hours table has one row per ``station_id`` and local wall-clock ``time`` (timestamp_ntz) with ``hour`` and the
measures. ``as_of`` is always an argument, never the clock of the machine.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import grading as G
from ..functions import labels as L

SITE = "station_id"
RAIN_TYPE = "decimal(12,6)"


def wall_clock(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def for_sites(rows: DataFrame, sites: DataFrame | None) -> DataFrame:
    """``rows`` with a row of NULLs for every one of ``sites`` (station_id, anything else) that has none."""
    return rows if sites is None else rows.join(sites.select(SITE).where(F.col(SITE).isNotNull()).distinct(), SITE, "full")


def known_rain() -> Column:
    """Rain as a decimal, so that sums do not depend on the order of the rows."""
    return F.col("precip_in").cast(RAIN_TYPE)


# --- slices ----------------------------------------------------------------------------------


def last_24h(hours: DataFrame, as_of: datetime) -> DataFrame:
    """Both ends inclusive."""
    return hours.filter(F.col("time").between(wall_clock(as_of - timedelta(hours=24)), wall_clock(as_of)))


def upcoming(hours: DataFrame, as_of: datetime) -> DataFrame:
    """From the running hour on."""
    return hours.filter(F.col("time") >= wall_clock(as_of.replace(minute=0, second=0, microsecond=0)))


def first_rows(hours: DataFrame, n: int, place: str = "_place") -> DataFrame:
    """The first ``n`` rows of every site in time order, numbered from 1. Every task cuts its own share to n rows
    per site before the shuffle."""
    w = Window.partitionBy(SITE).orderBy("time")
    return hours.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n)


# --- hourly verdicts -------------------------------------------------------------------------


def score_pour(hours: DataFrame) -> DataFrame:
    c = F.col
    factors = G.hourly_pour_factors(
        c("temp_f"), c("humidity_pct"), c("wind_mph"), c("precip_prob_pct"), c("dewpoint_f")
    )
    return hours.withColumns({"pour_score": G.label(G.worst(factors)), "pour_factors": G.factor_map(factors)})


def score_sealer(rows: DataFrame) -> DataFrame:
    """Needs ``rain_last_24h``, ``prob_next_24h`` and ``low_next_12h`` beside the current readings."""
    c = F.col
    factors = G.hourly_sealer_factors(
        c("temp_f"), c("humidity_pct"), c("rain_last_24h"), c("prob_next_24h"),
        c("dewpoint_f"), c("wind_mph"), c("low_next_12h"),
    )
    return rows.withColumns({"sealer_score": G.label(G.worst(factors)), "sealer_factors": G.factor_map(factors)})


# --- days ------------------------------------------------------------------------------------


def by_day(hours: DataFrame) -> DataFrame:
    """Adds the local ``date`` and brings the hours of a site-day together once for all day operators."""
    return hours.withColumn("date", F.col("time").cast("date")).repartition(SITE, "date")


def working(start: int, end: int) -> Column:
    return (F.col("hour") >= start) & (F.col("hour") < end)


def verdict_aggregates(start: int = R.WORK_START_HOUR, end: int = R.WORK_END_HOUR) -> list[Column]:
    """Worst working hour decides; a single unscored working hour caps the day at yellow; none scored is NULL."""
    sev = F.when(working(start, end), G.severity_of(F.col("pour_score")))
    worst = F.max(sev)
    rows, scored = F.count_if(working(start, end)), F.count(sev)
    verdict = F.when(scored < rows, F.greatest(worst, F.lit(R.YELLOW))).otherwise(worst)
    return [
        G.label(F.when(scored > 0, verdict)).alias("score"),
        F.max("temp_f").alias("temp_high_f"),
        F.min("temp_f").alias("temp_low_f"),
        rows.alias("working_hours"),
        (rows - scored).alias("unscored_hours"),
    ]


def day_verdicts(
    days: DataFrame, start: int = R.WORK_START_HOUR, end: int = R.WORK_END_HOUR
) -> DataFrame:
    return days.groupBy(SITE, "date").agg(*verdict_aggregates(start, end))


def best_windows(
    days: DataFrame, start: int = R.WORK_START_HOUR, end: int = R.WORK_END_HOUR
) -> DataFrame:
    """Longest run of green working hours, the first of equals; without any green hour the longest run of
    yellow or better. Runs are consecutive rows of the day, whatever their clock distance."""
    w = Window.partitionBy(SITE, "date").orderBy("time")  # at most one day of hours
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    sev = G.severity_of(F.col("pour_score"))
    fits = lambda limit: F.coalesce(working(start, end) & (sev <= limit), F.lit(False)).cast("int")
    numbered = (
        days.select(SITE, "date", "time", "hour", fits(R.GREEN).alias("_g"), fits(R.YELLOW).alias("_y"))
        .withColumn("_pos", F.row_number().over(w))
        .withColumn("_run_g", F.col("_pos") - F.sum("_g").over(running))
        .withColumn("_run_y", F.col("_pos") - F.sum("_y").over(running))
    )
    option = lambda grade, fit, run: F.struct(
        F.lit(grade).alias("grade"), F.col(fit).alias("fit"), F.col(run).alias("run")
    )
    runs = (
        numbered.select(
            SITE, "date", "hour", "_pos",
            F.explode(F.array(option(R.GREEN, "_g", "_run_g"), option(R.YELLOW, "_y", "_run_y"))).alias("o"),
        )
        .filter("o.fit = 1")
        .groupBy(SITE, "date", "o.grade", "o.run")
        .agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("_pos", "hour")).alias("first"))
    )
    best = runs.groupBy(SITE, "date").agg(
        F.min(
            F.struct(
                "grade",
                (-F.col("length")).alias("minus_length"),
                F.col("first._pos").alias("pos"),
                F.col("first.hour").alias("start_hour"),
            )
        ).alias("b")
    )
    window = L.window_text(F.col("b.start_hour"), -F.col("b.minus_length"))
    return best.select(
        SITE, "date",
        F.col("b.start_hour").alias("window_start"),
        (-F.col("b.minus_length")).alias("window_hours"),
        window.alias("best_window"),
    ).withColumn("best_window_label", L.window_label(F.col("best_window")))


def detail_dates(hours: DataFrame, as_of: datetime, detail_hours: int = R.DETAIL_HOURS) -> DataFrame:
    """Site-dates that hold one of the first ``detail_hours`` upcoming hours."""
    first = first_rows(upcoming(hours.select(SITE, "time"), as_of), detail_hours)
    return first.select(SITE, F.col("time").cast("date").alias("date")).distinct()


def best_overall(windows: DataFrame) -> DataFrame:
    """The longest day window of a site, the earliest date among equals."""
    pick = F.min(F.struct((-F.col("window_hours")).alias("h"), "date", "best_window", "best_window_label"))
    return windows.groupBy(SITE).agg(pick.alias("p")).select(
        SITE,
        F.col("p.date").alias("date"),
        F.col("p.best_window").alias("best_window"),
        F.col("p.best_window_label").alias("best_window_label"),
        (-F.col("p.h")).alias("window_hours"),
    )
