"""Boundary cases of the graders, one row per case with the expected verdict beside it."""

from decimal import Decimal

from pyspark.sql import functions as F

from fieldcast.functions import grading as G
from fieldcast.operators import daily, hours

HOUR = "temp_f double, humidity_pct double, wind_mph double, precip_prob_pct double, dewpoint_f double"


def check_hours(spark, cases):
    """cases: (inputs, factor or None, expected factor verdict, expected overall or '*')"""
    rows = [(*map(lambda v: None if v is None else float(v), x), f or "temperature", want, overall)
            for x, f, want, overall in cases]
    df = hours.score_pour(spark.createDataFrame(rows, HOUR + ", factor string, want string, overall string"))
    got = df.select(
        "want", F.col("pour_factors")[F.col("factor")].alias("got"), "overall", "pour_score", "temp_f"
    ).collect()
    for r in got:
        assert r.got == r.want, r
        assert r.overall == "*" or r.pour_score == r.overall, r


def test_pour_hour_limits(spark):
    t = lambda v: (v, 50, 5, 10, None)
    h = lambda v: (70, v, 5, 10, None)
    w = lambda v: (70, 50, v, 10, None)
    p = lambda v: (70, 50, 5, v, None)
    d = lambda v: (70, 50, 5, 10, v)
    cases = []
    for make, factor, limits in (
        (t, "temperature", {39: "red", 39.9: "red", 40: "yellow", 49: "yellow", 50: "green", 90: "green",
                            90.1: "yellow", 91: "yellow", 95: "yellow", 95.1: "red", 96: "red"}),
        (h, "humidity", {14: "red", 15: "yellow", 24: "yellow", 25: "green", 70: "green", 71: "yellow", 85: "yellow", 86: "red"}),
        (w, "wind", {9.9: "green", 10: "yellow", 19.9: "yellow", 20: "red"}),
        (p, "precipitation", {14: "green", 15: "yellow", 39: "yellow", 40: "red"}),
        (d, "dewpoint", {55: "green", 60: "yellow", 63: "yellow", 65: "red", 66: "red"}),
    ):
        cases += [(make(v), factor, want, want) for v, want in limits.items()]
    check_hours(spark, cases)


def test_missing_input_caps_and_red_stays_red(spark):
    check_hours(
        spark,
        [
            ((70, None, 5, None, None), "data", "yellow", "yellow"),
            ((30, None, 5, None, None), "data", "yellow", "red"),
            ((70, 50, 5, 10, None), "data", None, "green"),
            ((None, None, None, None, 40), "dewpoint", None, None),
            ((None, None, None, None, None), "data", None, None),
        ],
    )


def test_no_input_gives_an_empty_map(spark):
    row = hours.score_pour(spark.createDataFrame([(None,) * 5], HOUR)).first()
    assert row.pour_score is None and row.pour_factors == {}


def test_sealer_limits(spark):
    good = dict(temp_f=70, humidity_pct=50, rain_last_24h=0, prob_next_24h=5, dewpoint_f=55, wind_mph=5, low_next_12h=60)
    cases = [
        ({}, "data", None, "green"),
        ({"wind_mph": None}, "data", "yellow", "yellow"),
        ({"low_next_12h": None}, "data", "yellow", "yellow"),
        ({"rain_last_24h": None}, "data", "yellow", "yellow"),
        ({"dewpoint_f": None}, "data", None, "green"),
        ({"low_next_12h": 35}, "cure_temp", "red", "red"),
        ({"low_next_12h": 45}, "cure_temp", "yellow", "yellow"),
        ({"wind_mph": 12}, "wind", "yellow", "yellow"),
        ({"wind_mph": 15}, "wind", "red", "red"),
        ({"rain_last_24h": 0.003}, "rain_last_24h", "green", "green"),
        ({"rain_last_24h": 0.005}, "rain_last_24h", "yellow", "yellow"),
        ({"rain_last_24h": 0.05}, "rain_last_24h", "yellow", "yellow"),
        ({"rain_last_24h": 0.1}, "rain_last_24h", "red", "red"),
        ({"humidity_pct": 70}, "humidity", "yellow", "yellow"),
        ({"humidity_pct": 85}, "humidity", "red", "red"),
        ({"temp_f": 90}, "temperature", "green", "green"),
        ({"temp_f": 91}, "temperature", "red", "red"),
        ({"temp_f": 45, "dewpoint_f": 20}, "temperature", "yellow", "yellow"),
        ({"prob_next_24h": 10}, "rain_next_24h", "yellow", "yellow"),
        ({"prob_next_24h": 40}, "rain_next_24h", "red", "red"),
    ]
    names = list(good)
    rows = [
        tuple(None if v is None else float(v) for v in {**good, **c}.values()) + (f, want, overall)
        for c, f, want, overall in cases
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", factor string, want string, overall string")
    for r in hours.score_sealer(df).withColumn("got", F.col("sealer_factors")[F.col("factor")]).collect():
        assert (r.got, r.sealer_score) == (r.want, r.overall), r


def test_daily_scores(spark):
    d = lambda v: None if v is None else Decimal(str(v))
    cases = [
        # high, low, rain, wind -> pour, sealer
        (70, 55, 0, 5, "green", "green"),
        (70, 55, 0, None, "green", "green"),  # wind may be missing
        (None, 55, 0, 5, "yellow", "yellow"),
        (70, 55, None, 5, "yellow", "yellow"),
        (None, None, None, 5, "yellow", None),
        (None, None, None, None, None, None),
        (70, 55, 0.04, 5, "yellow", "yellow"),
        (70, 55, 0.05, 5, "yellow", "red"),
        (70, 55, 0.1, 5, "red", "red"),
        (99, 55, 0, 5, "red", "yellow"),  # heat alone never makes sealer red
        (70, 39, 0, 5, "green", "red"),
        (45, 40, 0, 20, "red", "yellow"),
    ]
    schema = "temp_max_f decimal(5,1), temp_min_f decimal(5,1), precip_in decimal(5,2), wind_max_mph decimal(5,1), p string, s string"
    df = spark.createDataFrame([(d(a), d(b), d(c), d(e), p, s) for a, b, c, e, p, s in cases], schema)
    for r in daily.score_days(df).collect():
        assert (r.pour_score, r.sealer_score) == (r.p, r.s), r


def test_unit_conversions_equal_binary_rounding(spark):
    values = list(range(-600, 3000, 7)) + [0, 1, 254, 127]
    df = spark.createDataFrame([("S", v, v, max(v, 0)) for v in values], "station_id string, a int, b int, c int")
    raw = df.select(
        "station_id", F.lit(None).cast("date").alias("observation_date"),
        F.col("a").alias("TMAX"), (F.col("a") - 13).alias("TMIN"), F.col("c").alias("PRCP"), F.col("c").alias("SNOW"),
        F.col("c").alias("SNWD"), F.lit(None).cast("int").alias("AWND"), F.lit(None).cast("int").alias("WSF2"),
        F.col("c").alias("WSF5"), F.col("a").alias("v"), F.col("c").alias("w"),
    )
    got = daily.convert_units(raw).collect()
    for v, r in zip(values, got):
        w = max(v, 0)
        high, low = round(v / 10 * 9 / 5 + 32, 1), round((v - 13) / 10 * 9 / 5 + 32, 1)
        assert float(r.temp_max_f) == high and float(r.temp_min_f) == low
        assert float(r.temp_mean_f) == round((high + low) / 2, 1)
        assert float(r.precip_in) == round(w / 10 / 25.4, 2)
        assert float(r.snow_in) == round(w / 25.4, 1)
        if w % 1000 != 500:
            assert float(r.wind_max_mph) == round(w / 10 * 2.237, 1)
        assert r.wind_avg_mph is None


def test_label_and_severity_are_inverse(spark):
    df = spark.createDataFrame([("green",), ("yellow",), ("red",), (None,)], "v string")
    rows = df.select("v", G.label(G.severity_of(F.col("v"))).alias("back")).collect()
    assert all(r.v == r.back for r in rows)
