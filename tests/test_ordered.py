"""Numbering and block frames against plain windows, with one key holding most rows and with tiny blocks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldcast.operators import climate, cure, ordered, sealer
from fieldcast.plans import derive as D

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.col("id").alias("t"),
        (F.xxhash64("id") % 50).alias("v"),
    )
    return df.repartition(7)


def test_row_numbers(spark, series):
    plain = F.row_number().over(Window.partitionBy("k").orderBy("t"))
    got = ordered.number_rows(series, ["k"], ["t"], F.floor(F.col("t") / 500)).withColumn("want", plain)
    assert got.count() == 6000 and got.filter("_row <> want").count() == 0


@pytest.mark.parametrize("size", [9, 64, 4096])
def test_frames_do_not_depend_on_the_blocks(spark, series, size):
    numbered = ordered.number_rows(series, ["k"], ["t"], F.floor(F.col("t") / 700))
    w, plain = ordered.block_window(["k"]), Window.partitionBy("k").orderBy("t")
    cut = ordered.blocks(numbered, before=8, after=5, block_rows=size)
    got = cut.withColumns(
        {"back": F.sum("v").over(w.rowsBetween(-8, 0)), "on": F.min("v").over(w.rowsBetween(0, 5))}
    ).filter("_core")
    want = series.withColumns(
        {"back2": F.sum("v").over(plain.rowsBetween(-8, 0)), "on2": F.min("v").over(plain.rowsBetween(0, 5))}
    )
    both = got.join(want.select("k", "t", "back2", "on2"), ["k", "t"])
    assert both.count() == 6000 and both.filter("back <> back2 or on <> on2").count() == 0


def test_block_must_hold_the_frame(spark, series):
    with pytest.raises(ValueError):
        ordered.blocks(series.withColumn("_row", F.lit(1)), before=29, block_rows=10)


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_operators_do_not_depend_on_the_blocks(spark):
    daily, stations = D.fact_table(spark, SF).drop("score_details"), D.stations(spark, SF)
    same(climate.temperature_anomalies(daily, stations, 30), climate.temperature_anomalies(daily, stations))
    same(climate.best_work_weeks(daily, stations, 1, 5), climate.best_work_weeks(daily.repartition(11), stations, 1))
    hourly = D.hourly(spark, SF)
    same(sealer.rolling_site_inputs(hourly, 24), sealer.rolling_site_inputs(hourly.repartition(5)))
    flat = lambda df: df.select("station_id", "time", "score", "hours", F.array_join("issues", "|"))
    same(flat(cure.rolling_cure(hourly, 48)), flat(cure.rolling_cure(hourly)))


def test_first_rows_are_cut_before_the_shuffle(spark):
    from fieldcast.operators.hours import first_rows

    plan = first_rows(D.hourly(spark, SF), 24)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fact_table_holds_what_analytics_read(spark):
    """All columns of the daily rows but the factor maps."""
    stored, daily = D.fact_table(spark, SF), D.daily(spark, SF)
    assert "score_details" in daily.columns and set(stored.columns) == {*daily.columns, "obs_year"} - {"score_details"}
    columns = [c for c in daily.columns if c != "score_details"]
    assert stored.select(columns).exceptAll(daily.select(columns)).isEmpty() and stored.count() == daily.count()
