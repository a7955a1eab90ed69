from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldcast.plans import reports
from fieldcast.sinks import tables
from fieldcast.streaming import jobs as streams

ROW = "station_id string, observation_date date, temp decimal(5,1), score string"
KEY = tables.DAILY_KEY


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW).withColumn("temp", F.col("temp"))


def d(v):
    from decimal import Decimal

    return None if v is None else Decimal(str(v))


def test_upsert_replaces_whole_rows_and_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    base = frame(spark, [("a", date(2020, 1, 1), d(1), "red"), ("a", date(2021, 1, 1), d(2), "red"),
                         ("b", date(2021, 1, 1), d(3), "red")]).withColumn("obs_year", F.year("observation_date"))
    tables.create_table(base, path, "obs_year", KEY)
    old = {p.name for p in (tmp_path / "t" / "obs_year=2020").iterdir()}
    change = spark.createDataFrame(
        [("a", date(2021, 1, 1), None, "green", 1), ("a", date(2021, 1, 1), d(9), "yellow", 2),
         ("c", date(2022, 1, 1), d(5), None, 3)], ROW + ", seq int").withColumn("obs_year", F.year("observation_date"))
    for _ in range(2):  # running it again changes nothing
        tables.upsert(spark, path, change, KEY, "obs_year", sequence="seq")
        got = {(r.station_id, r.observation_date): (r.temp, r.score) for r in spark.read.schema(base.schema).parquet(path).collect()}
        assert got == {
            ("a", date(2020, 1, 1)): (d(1), "red"), ("a", date(2021, 1, 1)): (d(9), "yellow"),
            ("b", date(2021, 1, 1)): (d(3), "red"), ("c", date(2022, 1, 1)): (d(5), None),
        }
    assert {p.name for p in (tmp_path / "t" / "obs_year=2020").iterdir()} == old


def test_writes_leave_few_files_and_differing_repeats_have_an_order(spark, tmp_path):
    path = str(tmp_path / "t")
    year = F.year("observation_date")
    rows = spark.range(600).select(
        F.concat(F.lit("s"), F.col("id") % 100).alias("station_id"), F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") / 3).cast("int") * 5).alias("observation_date"),
        (F.col("id") % 7).cast("decimal(5,1)").alias("temp"), F.lit("red").alias("score")).withColumn("obs_year", year)
    tables.create_table(rows.limit(0), path, "obs_year", KEY)
    tables.append_absent(spark, path, rows.repartition(40), KEY, "obs_year")
    files = lambda: [len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "t").glob("obs_year=*")]
    assert len(files()) == 3 and max(files()) <= tables.FILES
    differing = rows.withColumn("score", F.explode(F.array(F.lit("green"), F.lit("yellow"), F.lit(None))))
    for tasks in (3, 40):  # the same rows win however they arrive
        tables.upsert(spark, path, differing.repartition(tasks), KEY, "obs_year")
        stored = spark.read.schema(rows.schema).parquet(path)
        assert stored.count() == 600 and {r.score for r in stored.select("score").distinct().collect()} == {"yellow"}
        assert max(files()) <= tables.FILES
    ranked = tables.latest_per_key(differing.withColumn("seq", F.lit(1)), KEY, "seq")
    assert {r.score for r in ranked.select("score").distinct().collect()} == {"yellow"}


def snapshot(spark, rows):
    df = spark.createDataFrame(rows, "station_id string, forecast_hour timestamp_ntz, fetched_at timestamp_ntz, v int")
    at = F.col("fetched_at").cast("timestamp")
    return df.withColumn("fetched_at", at).withColumn("expires_at", at + F.expr("interval 1 hour")).withColumn(
        "fetched_date", at.cast("date"))


def test_append_if_absent(spark, tmp_path):
    path = str(tmp_path / "s")
    hour, t1, t2 = datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 4), datetime(2024, 1, 2, 4)
    first = snapshot(spark, [("a", hour, t1, 1)])
    tables.create_table(first, path, "fetched_date", tables.SNAPSHOT_KEY)
    offered = snapshot(spark, [("a", hour, t1, 99), ("a", hour, t2, 2), ("a", hour, t2, 2), ("b", hour, t1, 3)])
    tables.append_absent(spark, path, offered, tables.SNAPSHOT_KEY, "fetched_date")
    tables.append_absent(spark, path, offered, tables.SNAPSHOT_KEY, "fetched_date")
    got = sorted((r.station_id, r.fetched_at.day, r.v) for r in spark.read.schema(first.schema).parquet(path).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)]


@pytest.mark.parametrize("now", [datetime(2024, 1, 10, 5, 0), datetime(2024, 1, 10, 0, 30), datetime(2024, 1, 12, 0, 0)])
def test_retention_equals_the_row_rule(spark, tmp_path, now):
    path = str(tmp_path / "s")
    fetched = [datetime(2024, 1, day, h, m) for day in range(1, 6) for h, m in ((0, 0), (3, 59), (4, 0), (23, 30), (23, 45))]
    rows = snapshot(spark, [("a", t, t, i) for i, t in enumerate(fetched)])
    tables.create_table(rows, path, "fetched_date", tables.SNAPSHOT_KEY)
    want = {r.v for r in tables.unexpired(rows, now).collect()}
    tables.expire(spark, path, rows.schema, now)
    assert {r.v for r in spark.read.schema(rows.schema).parquet(path).collect()} == want
    assert 0 < len(want) < len(fetched)


def test_export_skips_an_empty_table(spark, tmp_path):
    from fieldcast.plans import derive as D

    path = str(tmp_path / "e")
    stations = D.stations(spark, "/root/testdata/sf0.001")
    assert tables.export_table(stations, "stations", path)
    assert not tables.export_table(stations.limit(0), "stations", path)
    back = spark.read.parquet(path)
    assert back.count() == stations.count() and dict(back.dtypes)["latitude"] == "double"


def test_layers(spark, tmp_path):
    df = spark.range(3)
    tables.materialise(df, "stg_x", "staging")
    tables.materialise(df, "mart_x", "marts", str(tmp_path))
    assert spark.table("stg_x").count() == spark.table("mart_x").count() == 3
    assert (tmp_path / "mart_x" / "_SUCCESS").exists()
    with pytest.raises(ValueError):
        tables.materialise(df, "mart_y", "marts")


def test_latest_rows_and_last_known(spark):
    rows = [("a", datetime(2024, 1, 1, h), h) for h in range(10)] + [("b", datetime(2024, 1, 2), 1)]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, v int")
    kept = tables.latest_rows(df, 3, [F.col("ts").desc()], ["station_id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before, once after the shuffle
    assert sorted((r.station_id, r.v) for r in kept.collect()) == [("a", 7), ("a", 8), ("a", 9), ("b", 1)]
    assert sorted(r.v for r in tables.latest_rows(df, 2, [F.col("ts").desc()]).collect()) == [1, 9]
    assert {(r.station_id, r.v) for r in tables.last_known(df, ["v"]).collect()} == {("a", 9), ("b", 1)}


def test_latest_snapshot_as_of(spark):
    hour = datetime(2024, 1, 1, 12)
    rows = [("a", hour, datetime(2024, 1, 1, 8), 1), ("a", hour, datetime(2024, 1, 1, 9), 2),
            ("a", hour, datetime(2024, 1, 1, 11), 3), ("b", hour, datetime(2024, 1, 1, 6), 4)]
    df = snapshot(spark, rows)
    got = {r.station_id: (r.v, r.stale) for r in streams.latest_snapshots(df, datetime(2024, 1, 1, 9, 59)).collect()}
    assert got == {"a": (2, False), "b": (4, True)}
    got = {r.station_id: (r.v, r.stale) for r in streams.latest_snapshots(df, datetime(2024, 1, 1, 10)).collect()}
    assert got["a"] == (2, True)  # exactly one hour old is outdated
    got = {r.station_id: r.stale for r in streams.latest_snapshots(df, datetime(2024, 1, 1, 9, 30), "history").collect()}
    assert got["a"] is True


def test_a_named_day_reads_its_year_only(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    rows = [("a", date(y, 1, 1), d(1), "red") for y in (2019, 2020, 2021)]
    base = frame(spark, rows).withColumn("obs_year", F.year("observation_date"))
    tables.create_table(base, path, "obs_year", KEY)
    daily = spark.read.schema(base.schema).parquet(path)
    found = reports.point(daily, "a", date(2020, 1, 1))
    found.explain("formatted")
    plan = capsys.readouterr().out
    line = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert "obs_year" in line and "2020" in line
    assert "EqualTo(station_id,a)" in plan and "observation_date" in plan.split("PushedFilters", 1)[1]
    assert [r["obs_year"] for r in found.collect()] == [2020]
    assert reports.point(daily.drop("obs_year"), "a", date(2020, 1, 1)).count() == 1
