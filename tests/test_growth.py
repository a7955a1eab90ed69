"""What a task holds, reads or writes does not grow with the tables."""

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from fieldcast import session
from fieldcast.operators import jobs, model, pairs
from fieldcast.plans import catalogue, derive as D
from fieldcast.sinks import tables

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def days(spark, stations: int, n: int):
    rows = [
        (f"s{s:02d}", date(2000, 1, 1) + timedelta(k), Decimal(k % 50), Decimal(k % 40), Decimal(k % 3), Decimal(5), "green")
        for s in range(stations) for k in range(n)
    ]
    return spark.createDataFrame(
        rows, "station_id string, observation_date date, temp_max_f decimal(5,1), temp_min_f decimal(5,1), "
        "precip_in decimal(5,2), wind_max_mph decimal(5,1), pour_score string")


def test_pairs_are_finished_when_they_leave_their_cell(spark):
    stations = spark.createDataFrame([(f"s{s:02d}", f"n{s}") for s in range(6)] + [("s01", None)], "station_id string, name string")
    frame = pairs.station_pairs(days(spark, 6, 1500), stations, 6)
    above = plan_of(frame).split("_cell(")[0]
    assert "Aggregate" not in above and "Join" not in above
    got = frame.collect()
    # a station that is listed twice is named twice, and both periods of years are in one row
    assert len(got) == 15 + 5 and {r.compared_days for r in got} == {1500}
    assert {r.station_b_name for r in got if r.station_a == "s00" and r.station_b == "s01"} == {"n1", None}


def test_landing_files_grow_with_the_table(spark, monkeypatch):
    assert catalogue.landing_files(spark, SF) == 1 and catalogue.landing_files(spark, SF, 4) == 4
    size = session.path_bytes(spark, f"{SF}/events.parquet")
    monkeypatch.setattr(catalogue, "LANDING_SHARE", size // 8)
    files = catalogue.landing_files(spark, SF)
    assert 8 <= files <= 9
    whole = catalogue.QUERIES["bounded_log"](spark, SF)
    assert whole.count() == 100


def test_the_split_orders_one_date(spark):
    rows = days(spark, 7, 9).withColumn("observation_date", F.when(F.col("temp_max_f") != 3, F.col("observation_date")))
    got = model.split_in_order(rows)
    assert "Join" not in plan_of(got)
    split = sorted((r.observation_date, r.station_id, r.is_train) for r in got.collect())
    # 63 rows, 7 of them without a date: the first 50 of the other 56
    assert [r[2] for r in split] == [True] * 50 + [False] * 6
    assert model.split_in_order(rows, 1.0).filter("is_train").count() == 56


def test_spans_carry_no_days(spark):
    spans = spark.createDataFrame([("s00", date(2000, 1, 5), date(2000, 2, 3)), ("s01", date(1999, 1, 1), date(2002, 1, 1))], "station_id string, start_date date, completion_date date")
    frame = jobs.span_weather(spans, days(spark, 2, 120))
    assert "collect_list" not in plan_of(frame)
    assert {r.station_id: r.green_days for r in frame.collect()} == {"s00": 30, "s01": 120}


def test_large_partitions_are_shared_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 50)
    rows = days(spark, 20, 60).withColumn("obs_year", F.when(F.col("station_id") < "s18", 2000).otherwise(2001))
    sizes = tables._added(tables._rows_of(rows, "obs_year"), {2001: 1, 2002: 3})
    assert sizes == {2000: 1080, 2001: 121, 2002: 3}
    plan = plan_of(tables._placed(rows, "obs_year", ["station_id", "observation_date"], sizes))
    # 22 shares of 50 rows for the one year that is large, FILES for the others
    assert plan.count("THEN 22 ") + plan.count("THEN 22L ") == 1 and f"ELSE {tables.FILES}" in plan


def test_archive_months_meet_as_a_row_per_day(spark):
    plan = plan_of(D.fixed_width_lines(D.daily_elements(spark, SF)))
    assert plan.count("explode(") == 1 and plan.index("explode(") < plan.index("collect_list(")
    elements = D.daily_elements(spark, SF).limit(1)
    undated = elements.withColumn("observation_date", F.lit(None).cast("date"))
    assert D.fixed_width_lines(elements.unionByName(undated)).count() == 8


def test_initial_shuffle_partitions_follow_the_table(spark, monkeypatch):
    key, before = session._INITIAL, spark.conf.get(session._INITIAL, None)
    try:
        size = session.path_bytes(spark, f"{SF}/lineitem.parquet")
        monkeypatch.setattr(session, "SHUFFLE_SHARE", size // 300)
        D.table(spark, SF, "lineitem")
        raised = int(spark.conf.get(key))
        assert 300 <= raised <= 302
        D.table(spark, SF, "nation")
        assert int(spark.conf.get(key)) == raised
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_the_archive_is_compressed_in_files_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(D, "_STORED", {})
    monkeypatch.setattr(D, "ARCHIVE_LINES", 1000)
    path = D.archive_files(spark, SF)
    files = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()
    assert len(files) > 4 and all(r.f.endswith(".gz") and r["count"] <= 1000 for r in files)
    # the same lines as by days that meet in months later
    plain = D.fixed_width_lines(D.daily_elements(spark, SF)).select("line")
    assert sorted(r[0] for r in spark.read.text(path).collect()) == sorted(r[0] for r in plain.collect())
    plan = D.fixed_width_lines(D._monthly_elements(spark, SF), D.MONTH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_months_of_rows_without_date_or_station(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").limit(400)
    k = F.col("l_orderkey")
    rows = rows.withColumns({"l_shipdate": F.when(k % 3 != 0, F.col("l_shipdate")), "l_suppkey": F.when(k % 5 != 0, F.col("l_suppkey"))})
    rows.unionByName(rows.limit(50)).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = lambda months: sorted(str(r.line) for r in months.collect())
    got = lines(D.fixed_width_lines(D._monthly_elements(spark, str(tmp_path)), D.MONTH))
    assert got == lines(D.fixed_width_lines(D.daily_elements(spark, str(tmp_path)))) and "None" in got
