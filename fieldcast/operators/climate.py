"""Analytics over the daily fact table: anomalies, streaks, seasonality, coverage, trends, work weeks, seasons.

Station names are joined after the heavy step and without a broadcast hint: Spark broadcasts the dimension while
its size is below the threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.numeric import exact_avg, percent, tenths
from .ordered import BLOCK_ROWS, block_window, blocks, core_rows, number_rows

DAY = "observation_date"


def _names(stations: DataFrame, *more: str) -> DataFrame:
    return stations.select("station_id", F.col("name").alias("station_name"), *more)


def _count_if(condition):
    return F.count_if(F.coalesce(condition, F.lit(False)))


def temperature_anomalies(daily: DataFrame, stations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean temperature against its 7-row average, flagged by the 30-row sample deviation.

    The flags are decided in integers (tenths of a degree, both sides squared), so a day exactly on the
    limit falls on the same side everywhere.
    """
    kept = daily.filter(F.col("temp_mean_f").isNotNull()).select(
        "station_id", DAY, "temp_mean_f", tenths(F.col("temp_mean_f")).alias("t")
    )
    numbered = number_rows(kept, ["station_id"], [DAY], F.year(DAY))
    # running sums inside a block; the sum of the last k rows is the difference of two of them
    w = block_window(["station_id"])
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("t")
    summed = blocks(numbered, before=29, block_rows=block_rows).withColumns(
        {"_s": F.sum(t).over(running), "_q": F.sum(t * t).over(running)}
    )
    last = lambda name, k: F.col(name) - F.lag(name, k, 0).over(w)
    framed = core_rows(
        summed.withColumns(
            {
                "s7": last("_s", 7),
                "s30": last("_s", 30),
                "q30": last("_q", 30),
                "n7": F.least(F.col("_row"), F.lit(7)),
                "n30": F.least(F.col("_row"), F.lit(30)),
            }
        )
    )
    n7, s7, n30 = F.col("n7"), F.col("s7"), F.col("n30")
    off = t * n7 - s7  # 10 * n7 * (temp - average)
    spread = n30 * F.col("q30") - F.col("s30") * F.col("s30")  # n(n-1) * variance in tenths²
    pairs = n30 * (n30 - 1)

    def beyond(times: int):
        measured = off * off * pairs > spread * n7 * n7 * times * times
        # no deviation yet (first row): a fixed 10 °F stands in
        assumed = F.abs(off) > n7 * (100 * times)
        return F.when(n30 < 2, assumed).otherwise(measured)

    as_tenths = lambda x: x.cast("decimal(18,0)") / F.lit(10).cast("decimal(3,0)")
    average = as_tenths(s7) / n7
    deviation = F.when(
        n30 >= 2, F.floor(F.sqrt(spread.cast("double") / pairs.cast("double")) + 0.5) / 10.0
    )
    return framed.join(_names(stations), "station_id").select(
        "station_id",
        "station_name",
        DAY,
        "temp_mean_f",
        F.round(average, 1).alias("temp_7d_avg"),
        F.round(as_tenths(off) / n7, 1).alias("temp_anomaly"),
        deviation.alias("temp_30d_stddev"),
        F.when(beyond(2), "EXTREME").when(beyond(1), "MODERATE").otherwise("NORMAL").alias("anomaly_flag"),
    )


def weather_streaks(daily: DataFrame, stations: DataFrame, min_days: int = 3) -> DataFrame:
    """Runs of dry or wet days. Unknown rain counts as dry; a missing date ends a run."""
    rain = F.coalesce(F.col("precip_in"), F.lit(0).cast("decimal(5,2)"))
    flagged = daily.select("station_id", DAY, rain.alias("rain"), (rain > 0).cast("int").alias("is_rain"))
    numbered = number_rows(flagged, ["station_id", "is_rain"], [DAY], F.year(DAY))
    runs = (
        numbered.groupBy("station_id", "is_rain", F.date_sub(DAY, F.col("_row").cast("int")).alias("_run"))
        .agg(
            F.min(DAY).alias("streak_start"),
            F.max(DAY).alias("streak_end"),
            F.count(F.lit(1)).alias("streak_days"),
            F.sum("rain").alias("total_precip_in"),
        )
        .filter(F.col("streak_days") >= min_days)
    )
    # runs are disjoint stretches of calendar days: a century of a station has at most 12,000 of three days
    longest = Window.partitionBy("station_id", "is_rain").orderBy(F.col("streak_days").desc())
    return runs.withColumn("streak_rank", F.rank().over(longest)).join(_names(stations), "station_id").select(
        "station_id",
        "station_name",
        F.when(F.col("is_rain") == 0, "DRY").otherwise("WET").alias("streak_type"),
        "streak_start",
        "streak_end",
        "streak_days",
        "total_precip_in",
        "streak_rank",
    )


def seasonal_viability(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Verdict mix, temperatures and rain per station and month."""
    rain = F.coalesce(F.col("precip_in"), F.lit(0).cast("decimal(5,2)"))
    pour, sealer = F.col("pour_score"), F.col("sealer_score")
    monthly = daily.groupBy(
        "station_id",
        F.year(DAY).alias("year"),
        F.month(DAY).alias("month_num"),
    ).agg(
        F.count(F.lit(1)).alias("total_days"),
        _count_if(pour == "green").alias("pour_green"),
        _count_if(pour == "yellow").alias("pour_yellow"),
        _count_if(pour == "red").alias("pour_red"),
        _count_if(sealer == "green").alias("sealer_green"),
        exact_avg(F.col("temp_max_f"), 1).alias("avg_high"),
        exact_avg(F.col("temp_min_f"), 1).alias("avg_low"),
        F.round(F.sum(rain), 1).alias("total_precip_in"),
        _count_if(rain > 0).alias("rainy_days"),
    )
    total = F.col("total_days")
    return monthly.join(_names(stations, "covers"), "station_id").select(
        "station_id", "station_name", "covers", "year", "month_num",
        F.date_format(F.make_date("year", "month_num", F.lit(1)), "MMM").alias("month_name"),
        "total_days", "pour_green", "pour_yellow", "pour_red",
        percent(F.col("pour_green"), total).alias("pct_pour_green"),
        "sealer_green",
        percent(F.col("sealer_green"), total).alias("pct_sealer_green"),
        "avg_high", "avg_low", "total_precip_in", "rainy_days",
    )


def coverage_audit(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Days present against the calendar span of the whole table. A station without a single row shows
    one missing reading each, as its outer-joined NULL row counts."""
    per_station = daily.groupBy("station_id").agg(
        F.count_distinct(DAY).alias("days_with_data"),
        _count_if(F.col("temp_max_f").isNull()).alias("missing_temp"),
        _count_if(F.col("precip_in").isNull()).alias("missing_precip"),
        _count_if(F.col("wind_max_mph").isNull()).alias("missing_wind"),
        F.min(DAY).alias("first_date"),
        F.max(DAY).alias("last_date"),
    )
    span = daily.agg((F.datediff(F.max(DAY), F.min(DAY)) + 1).cast("bigint").alias("n"))
    days = F.coalesce(F.col("days_with_data"), F.lit(0))
    missing = lambda name: F.coalesce(F.col(name), F.lit(1)).alias(name)
    return (
        _names(stations, "covers")
        .join(per_station, "station_id", "left")
        .withColumn("expected_days", F.coalesce(span.scalar(), F.lit(0)))
        .select(
            "station_id", "station_name", "covers",
            days.alias("days_with_data"),
            "expected_days",
            percent(days, F.col("expected_days")).alias("coverage_pct"),
            missing("missing_temp"), missing("missing_precip"), missing("missing_wind"),
            "first_date", "last_date",
            (F.col("expected_days") - days).alias("gap_days"),
        )
    )


def date_spine(daily: DataFrame) -> DataFrame:
    """Every calendar day between the first and the last observation."""
    ends = daily.agg(F.min(DAY).alias("a"), F.max(DAY).alias("b")).filter(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("expected_date"))


def spine_gaps(daily: DataFrame) -> DataFrame:
    """How many stations reported on each calendar day of the span."""
    reported = daily.groupBy(F.col(DAY).alias("expected_date")).agg(
        F.count_distinct("station_id").alias("stations_reporting")
    )
    return date_spine(daily).join(reported, "expected_date", "left").select(
        "expected_date", F.coalesce("stations_reporting", F.lit(0)).alias("stations_reporting")
    )


def year_over_year(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Monthly figures beside those of the previous year that has the month."""
    rain = F.coalesce(F.col("precip_in"), F.lit(0).cast("decimal(5,2)"))
    monthly = (
        daily.filter(F.col("temp_mean_f").isNotNull())
        .groupBy("station_id", F.year(DAY).alias("year"), F.month(DAY).alias("month"))
        .agg(
            exact_avg(F.col("temp_mean_f"), 1).alias("avg_temp"),
            F.sum(rain).alias("total_precip"),
            _count_if(F.col("pour_score") == "green").alias("green_days"),
            F.count(F.lit(1)).alias("total_days"),
        )
    )
    w = Window.partitionBy("station_id", "month").orderBy("year")  # one row per year: small by nature
    return (
        monthly.withColumn("prev_year_avg_temp", F.lag("avg_temp").over(w))
        .withColumn("prev_year_green_days", F.lag("green_days").over(w))
        .join(_names(stations), "station_id")
        .select(
            "station_id", "station_name", "year", "month",
            F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMM").alias("month_name"),
            "avg_temp", "total_precip", "green_days", "total_days", "prev_year_avg_temp",
            (F.col("avg_temp") - F.col("prev_year_avg_temp")).alias("temp_change_yoy"),
            "prev_year_green_days",
        )
    )


def best_work_weeks(
    daily: DataFrame, stations: DataFrame, min_green: int = 3, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Five consecutive scored rows with at least ``min_green`` green days, ranked per station and year."""
    scored = daily.filter(F.col("pour_score").isNotNull()).select(
        "station_id", DAY, "pour_score", "temp_max_f"
    )
    numbered = number_rows(scored, ["station_id"], [DAY], F.year(DAY))
    five = block_window(["station_id"]).rowsBetween(-4, 0)
    count = lambda colour: F.sum((F.col("pour_score") == colour).cast("bigint")).over(five)
    framed = core_rows(
        blocks(numbered, before=4, block_rows=block_rows).withColumns(
            {
                "green_in_5day": count("green"),
                "red_in_5day": count("red"),
                "_sum": F.sum("temp_max_f").over(five),
                "_known": F.count("temp_max_f").over(five),
            }
        )
    ).filter(F.col("green_in_5day") >= min_green)
    weeks = framed.select(
        "station_id",
        F.year(DAY).alias("year"),
        F.date_sub(DAY, 4).alias("week_starting"),
        F.col(DAY).alias("week_ending"),
        "green_in_5day",
        "red_in_5day",
        F.when(F.col("_known") > 0, F.round(F.col("_sum") / F.col("_known"), 1)).alias("avg_high_5day"),
    )
    # at most one row per day of the year
    best = Window.partitionBy("station_id", "year").orderBy(
        F.col("green_in_5day").desc(), F.col("red_in_5day").asc()
    )
    ranked = weeks.withColumn("year_rank", F.rank().over(best))
    return ranked.join(_names(stations), "station_id").select(
        "station_id", "station_name", "week_starting", "week_ending",
        "green_in_5day", "red_in_5day", "avg_high_5day", "year_rank",
    )


def season_bounds(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """First and last workable day of each station-year inside the season band."""
    workable = daily.filter(
        F.col("pour_score").isin("green", "yellow")
        & F.dayofyear(DAY).between(R.SEASON_FIRST_DOY, R.SEASON_LAST_DOY)
    )
    yearly = workable.groupBy("station_id", F.year(DAY).alias("year")).agg(
        F.min(DAY).alias("season_start_approx"),
        F.max(DAY).alias("season_end_approx"),
        _count_if(F.col("pour_score") == "green").alias("total_green_days"),
        _count_if(F.col("pour_score") == "yellow").alias("total_yellow_days"),
    )
    return yearly.join(_names(stations), "station_id").select(
        "station_id", "station_name", "year", "season_start_approx", "season_end_approx",
        F.datediff("season_end_approx", "season_start_approx").alias("season_length_days"),
        "total_green_days", "total_yellow_days",
    )
