"""Jobs beside the weather of their days.

Summaries of a span are never laid out day by day. The days of its first and of its last month are summed where they meet
the span; the whole months between are read off a calendar of months with running sums, as the difference of two readings. For
the strongest wind, every month knows the maximum of the 1, 2, 4, ... months that start with it, and the whole months are
covered by two such stretches. A span of a century costs two months of days and four lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .climate import DAY

SPAN = ["station_id", "start_date", "completion_date"]
CARRIED = [
    "job_id", "lead_name", "address", "job_type", "concrete_type", "start_date", "completion_date",
    "job_duration_days", "final_revenue", "square_footage", "revenue_per_sqft", "sealer_coats",
]
MONTH = "_month"


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _first_of(month: Column) -> Column:
    return F.make_date(F.floor(month / F.lit(12)).cast("int"), F.pmod(month, F.lit(12)) + 1, F.lit(1))


def _bounds(daily: DataFrame) -> DataFrame:
    """(station_id, first, last): the months between which a station has rows."""
    return daily.groupBy("station_id").agg(F.min(_month(F.col(DAY))).alias("first"), F.max(_month(F.col(DAY))).alias("last"))


def _measured() -> dict[str, Column]:
    """What is summed over the days of a span, each as a column that is never NULL."""
    rain = F.coalesce(F.col("precip_in"), F.lit(0).cast("decimal(5,2)"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    tenths = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(5,1)"))
    pour = F.col("pour_score")
    return {
        "days": F.lit(1).cast("bigint"),
        "highs": tenths("temp_max_f"), "n_highs": flag(F.col("temp_max_f").isNotNull()),
        "lows": tenths("temp_min_f"), "n_lows": flag(F.col("temp_min_f").isNotNull()),
        "rain": rain, "rainy": flag(rain > 0), "no_rain": flag(F.col("precip_in").isNull()),
        "green": flag(pour == "green"), "yellow": flag(pour == "yellow"), "red": flag(pour == "red"),
    }


def _parts(rows: DataFrame, keys: list, named: dict[str, Column]) -> DataFrame:
    """Sums and the strongest wind of the days of each group."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in named.items()], F.max("wind_max_mph").alias("wind"))


def _whole_months(inner: DataFrame, daily: DataFrame) -> DataFrame:
    """Sums and the strongest wind of the months ``first`` to ``last`` of each row of ``inner`` (SPAN, first, last).

    Sums are the difference of running sums at both ends. For the wind a month knows the maximum of the 1, 2, 4, ...
    months from it on, and a stretch is covered by two of those. Only stations of ``inner`` have such a calendar."""
    named = list(_measured())
    asked = inner.select("station_id").distinct()
    days = daily.join(asked, "station_id", "left_semi").withColumn(MONTH, _month(F.col(DAY)))
    months = _parts(days, ["station_id", MONTH], _measured())
    every = _bounds(days).select("station_id", F.sequence(F.col("first") - 1, "last").alias("all"))
    longest = every.agg(F.max(F.size("all"))).first()[0] or 1
    levels = int(longest).bit_length()
    dense = every.select("station_id", F.explode("all").alias(MONTH)).join(months, ["station_id", MONTH], "left")
    order = Window.partitionBy("station_id").orderBy(MONTH)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    types = dict(months.dtypes)
    run = dense.select("station_id", MONTH, "wind", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).cast(types[n]).alias(n) for n in named])
    run = run.withColumn("_r0", F.col("wind"))
    for level in range(1, levels):  # greatest() skips NULLs
        half = F.col(f"_r{level - 1}")
        run = run.withColumn(f"_r{level}", F.greatest(half, F.lead(half, 1 << (level - 1)).over(order)))
    reach = F.array(*[F.col(f"_r{level}") for level in range(levels)]).alias("reach")
    calendar = stored(run.select("station_id", MONTH, F.struct(*named).alias("sums"), reach), "calendar")

    def at(rows: DataFrame, month: Column, column: str, name: str) -> DataFrame:
        read = calendar.select(F.col("station_id").alias("_s"), F.col(MONTH).alias("_m"), F.col(column).alias(name))
        return rows.join(read, (F.col("station_id") == F.col("_s")) & (month == F.col("_m"))).drop("_s", "_m")

    length = F.col("last") - F.col("first") + 1
    rows = inner.withColumn("level", F.floor(F.log2(length + F.lit(0.5))).cast("int"))
    rows = at(at(rows, F.col("first") - 1, "sums", "_b"), F.col("last"), "sums", "_e")
    rows = at(rows, F.col("first"), "reach", "r0")
    rows = at(rows, F.col("last") + 1 - F.call_function("shiftleft", F.lit(1), F.col("level")), "reach", "r1")
    return rows.select(
        *SPAN, *[(F.col(f"_e.{n}") - F.col(f"_b.{n}")).cast(types[n]).alias(n) for n in named],
        F.greatest(F.get("r0", F.col("level")), F.get("r1", F.col("level"))).alias("wind"),
    )


def span_weather(spans: DataFrame, daily: DataFrame) -> DataFrame:
    """Weather summary of the distinct ``spans`` (station_id, start_date, completion_date) that have a day with weather;
    open and reversed spans have none.

    A span is its first month, its last month and the whole months between. The days of a first or last month, 31 at most,
    are summed where span and days of the station's month meet; whole months come from ``_whole_months``. What goes on
    from there is a narrow row per part."""
    given = spans.filter(F.col("station_id").isNotNull() & (F.col("completion_date") >= F.col("start_date")))
    closed = given.distinct()
    start, end = _month(F.col("start_date")), _month(F.col("completion_date"))
    heads = closed.select(*SPAN, start.alias(MONTH))
    tails = closed.filter(end > start).select(*SPAN, end.alias(MONTH))
    days = daily.withColumn(MONTH, _month(F.col(DAY))).select(
        "station_id", MONTH, DAY, "temp_max_f", "temp_min_f", "precip_in", "wind_max_mph", "pour_score"
    )
    inside = heads.unionByName(tails).join(days, ["station_id", MONTH]).filter(F.col(DAY).between(F.col("start_date"), F.col("completion_date")))
    opening = F.struct("temp_max_f", "precip_in", "pour_score")
    edges = inside.groupBy(*SPAN, MONTH).agg(
        *[F.sum(c).alias(n) for n, c in _measured().items()], F.max("wind_max_mph").alias("wind"),
        F.min(F.when(F.col(DAY) == F.col("start_date"), opening)).alias("_first"),
    ).drop(MONTH)
    parts, long = edges, closed.filter(end - start > 1)
    if not given.filter(end - start > 1).isEmpty():  # asked of the rows as they are: no shuffle
        inner = long.select(*SPAN, (start + 1).alias("m0"), (end - 1).alias("m1")).join(_bounds(daily), "station_id")
        inner = inner.select(*SPAN, F.greatest("m0", "first").alias("first"), F.least("m1", "last").alias("last"))
        parts = edges.unionByName(_whole_months(inner.filter(F.col("first") <= F.col("last")), daily), allowMissingColumns=True)
    rows = parts.groupBy(*SPAN).agg(
        *[F.sum(n).alias(f"_{n}") for n in _measured()], F.max("wind").alias("max_wind_mph"), F.min("_first").alias("_first")
    ).filter(F.col("_days") > 0)
    average = lambda total, n: F.round(
        F.col(f"_{total}").cast("decimal(15,1)") / F.nullif(F.col(f"_{n}").cast("bigint"), F.lit(0).cast("bigint")), 1
    )
    count = lambda n: F.col(f"_{n}").cast("bigint")
    return rows.select(
        *SPAN,
        average("highs", "n_highs").alias("avg_high"),
        average("lows", "n_lows").alias("avg_low"),
        F.col("_rain").cast("decimal(15,2)").alias("total_precip_in"),
        count("rainy").alias("rainy_days"),
        count("no_rain").alias("missing_precip_days"),
        count("green").alias("green_days"),
        count("yellow").alias("yellow_days"),
        count("red").alias("red_days"),
        "max_wind_mph",
        F.col("_first.temp_max_f").alias("pour_day_high"),
        F.col("_first.precip_in").alias("pour_day_precip"),
        F.col("_first.pour_score").alias("pour_day_score"),
    )


def job_days(jobs: DataFrame, daily: DataFrame) -> DataFrame:
    """Day-by-day weather of every staged job. Spans are cut to the months their station has, so only days that may
    have weather are laid out; reversed and open spans have none."""
    weather = daily.select(
        "station_id", DAY, "temp_max_f", "temp_min_f", "precip_in", "wind_max_mph", "pour_score", "sealer_score"
    )
    closed = jobs.select("job_id", *SPAN).filter(F.col("completion_date") >= F.col("start_date")).join(_bounds(daily), "station_id")
    first = F.greatest("start_date", _first_of(F.col("first")))
    last = F.least("completion_date", F.last_day(_first_of(F.col("last"))))
    cut = closed.withColumn("_from", first).withColumn("_to", last).drop("first", "last").filter(F.col("_to") >= F.col("_from"))
    laid = cut.withColumn(DAY, F.explode(F.sequence("_from", "_to", F.expr("interval 1 day")))).drop("_from", "_to")
    return laid.join(weather, ["station_id", DAY])


def job_weather(jobs: DataFrame, daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Weather summary per staged job. Jobs that share station, start and completion share their weather, which is read
    once."""
    names = stations.select("station_id", F.col("name").alias("station_name"))
    return jobs.select("station_id", *CARRIED).join(span_weather(jobs.select(*SPAN), daily), SPAN).join(names, "station_id")
