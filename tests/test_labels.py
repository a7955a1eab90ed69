from datetime import date

from pyspark.sql import functions as F

from fieldcast.functions import labels as L
from fieldcast.functions.numeric import fixed, whole


def test_clock(spark):
    rows = spark.createDataFrame(
        [(0, "12am", "12a"), (7, "7am", "7a"), (12, "12pm", "12p"), (13, "1pm", "1p"), (23, "11pm", "11p")],
        "h int, long string, short string",
    ).select("long", "short", L.clock(F.col("h")).alias("a"), L.clock_short(F.col("h")).alias("b")).collect()
    assert all((r.a, r.b) == (r.long, r.short) for r in rows)


def test_span_phrases(spark):
    cases = [
        (list(range(7, 17)), "all day"),
        ([7, 8, 9], "before 10am"),
        ([14, 15, 16], "after 2pm"),
        ([13, 10, 12, 11], "10am-2pm"),
        ([15, 8, 12], "8am, 12pm, 3pm"),
        ([8, 10, 12, 14, 16], "8am-5pm, on and off"),
        ([7], "before 8am"),
        ([16], "after 4pm"),
        ([], ""),
    ]
    df = spark.createDataFrame(cases, "h array<int>, want string")
    for r in df.select("want", L.span_phrase("h", 7, 17).alias("got")).collect():
        assert r.got == r.want


def test_window_labels(spark):
    df = spark.createDataFrame(
        [("07:00-12:00", "7a-12p"), ("13:00-17:00", "1p-5p"), ("soon", "soon"), (None, None), ("", None)],
        "w string, want string",
    )
    for r in df.select("want", L.window_label(F.col("w")).alias("got")).collect():
        assert r.got == r.want
    built = spark.range(1).select(L.window_text(F.lit(7), F.lit(5)).alias("w")).first().w
    assert built == "07:00-12:00"


def test_day_labels_and_dates(spark):
    today = date(2024, 1, 15)
    df = spark.createDataFrame(
        [(date(2024, 1, 15), "Today"), (date(2024, 1, 16), "Tomorrow"), (date(2024, 1, 14), "Yesterday"),
         (date(2024, 1, 20), "Sat")], "d date, want string")
    for r in df.select("want", L.day_label(F.col("d"), F.lit(today)).alias("got")).collect():
        assert r.got == r.want
    texts = spark.createDataFrame([("2024-02-29", True), ("2023-02-29", False), ("2024-2-9", False), ("x", False)], "s string, ok boolean")
    for r in texts.select("ok", L.strict_date(F.col("s")).isNotNull().alias("got")).collect():
        assert r.got == r.ok


def test_formatting_follows_the_binary_value(spark):
    values = [2.5, 3.5, 0.125, 1234.5, -0.4, 99.95, 72.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, r in zip(values, df.select(whole(F.col("v")).alias("a"), fixed(F.col("v"), 2).alias("b")).collect()):
        assert (r.a, r.b) == (f"{v:.0f}", f"{v:.2f}")


def test_verdict_texts(spark):
    df = spark.createDataFrame([("green",), ("yellow",), ("red",), (None,)], "v string")
    rows = df.select(L.sealer_verdict_text(F.col("v")).alias("s"), L.cure_verdict_text(F.col("v")).alias("c")).collect()
    assert [r.s for r in rows] == ["SAFE TO SEAL", "USE CAUTION", "DO NOT SEAL", "NO DATA — DO NOT SEAL"]
    assert [r.c for r in rows] == ["SAFE TO POUR & CURE", "POUR WITH CAUTION", "DO NOT POUR", "NO DATA — DO NOT POUR"]
