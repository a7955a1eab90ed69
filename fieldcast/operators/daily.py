"""Daily observations: unit conversion, verdicts, staging views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import units as U

MEASURES = [
    "temp_max_f", "temp_min_f", "temp_mean_f", "precip_in", "snow_in",
    "snow_depth_in", "wind_avg_mph", "wind_max_mph",
]


def convert_units(raw: DataFrame) -> DataFrame:
    """Archive elements (TMAX, TMIN, ... as integer columns) to working units."""
    c = F.col
    high, low = U.fahrenheit_from_tenths_c(c("TMAX")), U.fahrenheit_from_tenths_c(c("TMIN"))
    return raw.select(
        "station_id",
        "observation_date",
        high.alias("temp_max_f"),
        low.alias("temp_min_f"),
        U.inches_from_tenths_mm(c("PRCP")).alias("precip_in"),
        U.inches_from_mm(c("SNOW")).alias("snow_in"),
        U.inches_from_mm(c("SNWD")).alias("snow_depth_in"),
        U.mph_from_tenths_ms(c("AWND")).alias("wind_avg_mph"),
        U.mph_from_tenths_ms(U.observed_gust(c("WSF2"), c("WSF5"))).alias("wind_max_mph"),
    ).select(
        "station_id", "observation_date", "temp_max_f", "temp_min_f",
        U.mean_temperature(c("temp_max_f"), c("temp_min_f")).alias("temp_mean_f"),
        *MEASURES[3:],
    )


def score_days(daily: DataFrame) -> DataFrame:
    """Adds ``pour_score``, ``sealer_score`` and ``score_details`` (one factor map per kind of work)."""
    c = F.col
    pour = G.daily_pour_factors(c("temp_max_f"), c("precip_in"), c("wind_max_mph"))
    sealer = G.daily_sealer_factors(c("temp_max_f"), c("temp_min_f"), c("precip_in"))
    return daily.withColumns(
        {
            "pour_score": G.label(G.worst(pour)),
            "sealer_score": G.label(G.worst(sealer)),
            "score_details": F.struct(G.factor_map(pour).alias("pour"), G.factor_map(sealer).alias("sealer")),
        }
    )


def stage_daily(daily: DataFrame) -> DataFrame:
    nothing = F.col("temp_max_f").isNull() & F.col("temp_min_f").isNull() & F.col("precip_in").isNull()
    return daily.filter(F.col("observation_date").isNotNull()).withColumn("is_incomplete_record", nothing)


def stage_stations(stations: DataFrame) -> DataFrame:
    return stations.select(
        "station_id",
        F.col("name").alias("station_name"),
        F.col("covers").alias("coverage_area"),
        "state", "latitude", "longitude", "elevation_m",
    )


def stage_jobs(jobs: DataFrame) -> DataFrame:
    area = F.col("square_footage")
    return (
        jobs.filter(F.col("start_date").isNotNull())
        .withColumn("job_duration_days", F.datediff("completion_date", "start_date"))
        .withColumn(
            "revenue_per_sqft",
            F.when(area > 0, F.round(F.col("final_revenue") / area.cast("decimal(10,0)"), 2)),
        )
    )
