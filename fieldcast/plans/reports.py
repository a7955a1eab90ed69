"""Parameterised analytic queries: filter, order, top rows.

A filter on a town goes to ``station_id`` before any window or aggregate, where it prunes the scan. Every
top list ends in a unique tie-break. An unknown town leaves the table unfiltered.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import strict_date
from ..operators import climate, jobs as J, pairs

TOP = 50


def _of_town(df: DataFrame, station_id: str | None) -> DataFrame:
    return df.filter(F.col("station_id") == station_id) if station_id else df


def _where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def _in_days(daily: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of a span of days: the dates reach the scan, and the years prune folders where the table has them."""
    kept = daily.filter(F.col(climate.DAY).between(F.lit(first), F.lit(last)))
    return kept.filter(F.col("obs_year").between(first.year, last.year)) if "obs_year" in daily.columns else kept


def town_station(stations: DataFrame, name: str | None) -> str | None:
    """Station id of a station name, None when there is no such town."""
    if not name:
        return None
    row = stations.filter(F.col("name") == name).agg(F.min("station_id")).first()
    return row[0]


def seasonal(daily, stations, station_id=None, year: int | None = None) -> DataFrame:
    kept = _of_town(daily, station_id)
    if year is not None:
        kept = _in_days(kept, date(year, 1, 1), date(year, 12, 31))
    return climate.seasonal_viability(kept, stations).orderBy("station_name", "station_id", "year", "month_num")


def streaks(daily, stations, station_id=None, streak_type: str | None = None, min_days: int = 3) -> DataFrame:
    runs = climate.weather_streaks(_of_town(daily, station_id), stations)
    kind = F.col("streak_type") == streak_type if streak_type in ("DRY", "WET") else None
    return _where(runs, F.col("streak_days") >= min_days, kind).orderBy(
        F.col("streak_days").desc(), "station_id", "streak_start"
    ).limit(TOP)


def anomalies(daily, stations, station_id=None, flag: str = "EXTREME") -> DataFrame:
    rows = climate.temperature_anomalies(_of_town(daily, station_id), stations)
    return rows.filter(F.col("anomaly_flag") == flag).orderBy(
        F.abs("temp_anomaly").desc(), "station_id", climate.DAY
    ).limit(TOP)


def quality(daily, stations) -> DataFrame:
    return climate.coverage_audit(daily, stations).orderBy("coverage_pct", "station_id")


def seasons(daily, stations, station_id=None) -> DataFrame:
    return climate.season_bounds(_of_town(daily, station_id), stations).orderBy("station_name", "station_id", "year")


def yearly_change(daily, stations, station_id=None) -> DataFrame:
    rows = climate.year_over_year(_of_town(daily, station_id), stations)
    return rows.filter(F.col("prev_year_avg_temp").isNotNull()).orderBy(
        "station_name", "station_id", "month", "year"
    )


def best_weeks(daily, stations, station_id=None, year: int | None = None) -> DataFrame:
    rows = climate.best_work_weeks(_of_town(daily, station_id), stations)
    return _where(
        rows, F.col("year_rank") <= 10, None if year is None else F.year("week_ending") == year
    ).orderBy(
        F.col("green_in_5day").desc(), F.col("avg_high_5day").desc_nulls_first(), "station_id", "week_ending"
    ).limit(TOP)


def comparison(daily, stations, within: str | None = None) -> DataFrame:
    return pairs.station_pairs(daily, stations, within=within, ordered=True)


def job_list(staged_jobs, daily, stations) -> DataFrame:
    return J.job_weather(staged_jobs, daily, stations).orderBy(F.col("start_date").desc(), "job_id")


def one_job(staged_jobs, daily, job_id: int) -> DataFrame:
    return J.job_days(staged_jobs.filter(F.col("job_id") == job_id), daily).orderBy(climate.DAY)


def points_by_text(requests: DataFrame, stations: DataFrame, daily: DataFrame) -> DataFrame:
    """Answers to requests (town, date, anything else) for the weather of a day, both given as text: one row per request with
    ``status`` and, where that is ``ok``, the measures of the day. An unknown town is told before an invalid date, and that
    before a day without data. Of stations with one name the smallest id answers."""
    towns = stations.groupBy(F.col("name").alias("_town")).agg(F.min("station_id").alias("station_id"))
    days = daily.drop("obs_year").withColumnRenamed("station_id", "_s")
    asked = requests.join(towns, F.col("town") == F.col("_town"), "left").drop("_town").withColumn("_day", strict_date(F.col("date")))
    found = asked.join(days, (F.col("station_id") == F.col("_s")) & (F.col("_day") == F.col(climate.DAY)), "left")
    status = (
        F.when(F.col("station_id").isNull(), "unknown town").when(F.col("_day").isNull(), "invalid date")
        .when(F.col("_s").isNull(), "no data").otherwise("ok")
    )
    return found.withColumn("status", status).drop("_s", "_day", climate.DAY)


def point(daily: DataFrame, station_id: str, day: date) -> DataFrame:
    """One station-day; zeros stay zeros."""
    return _in_days(daily.filter(F.col("station_id") == station_id), day, day)
