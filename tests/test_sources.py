import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldcast.plans import derive as D
from fieldcast.sources import documents, station_files, tables
from fieldcast import schemas as S


def line(station, year, month, element, values, flags=None):
    flags = flags or {}
    slots = "".join(f"{values.get(d, -9999):>5} {flags.get(d, ' ')} " for d in range(1, 32))
    return f"{station:<11}{year}{month:02d}{element}{slots}"


def parse(spark, path, **kw):
    return station_files.observations(station_files.parse_lines(station_files.read_lines(spark, path), **kw))


def test_station_file(spark, tmp_path):
    lines = [
        line("USW00000001", 2023, 2, "TMAX", {1: 100, 2: -50, 28: 0, 29: 77, 31: 5}),  # 29 and 31 do not exist
        line("USW00000001", 2023, 2, "PRCP", {1: 12, 2: 7}, {2: "X"}),  # day 2 failed its check
        line("USW00000001", 2023, 2, "TAVG", {1: 1}),  # not a wanted element
        line("USW00000001", 2020, 2, "TMAX", {1: 1}),  # too old
        line("USW00000001", 2023, 2, "SNOW", {})[:200],  # cut off
        line("USW00000001", 2023, 2, "TMAX", {2: -40}),  # later line wins where it has a value
        line("USW00000002", 2024, 2, "TMIN", {29: -1}),
    ]
    (tmp_path / "a.dly").write_text("\n".join(lines) + "\n")
    got = {(r.station_id, r.observation_date): r for r in parse(spark, str(tmp_path)).collect()}
    assert set(got) == {
        ("USW00000001", date(2023, 2, 1)), ("USW00000001", date(2023, 2, 2)), ("USW00000001", date(2023, 2, 28)),
        ("USW00000002", date(2024, 2, 29)),
    }
    one, two = got["USW00000001", date(2023, 2, 1)], got["USW00000001", date(2023, 2, 2)]
    assert (one.TMAX, one.PRCP, one.SNOW) == (100, 12, None)
    assert (two.TMAX, two.PRCP) == (-40, None)
    repeated = station_files.repeated_lines(station_files.read_lines(spark, str(tmp_path))).collect()
    assert len(repeated) == 1


def test_last_line_wins_across_file_splits(spark, tmp_path):
    lines = [line("USW00000001", 2023, 1, "TMAX", {1: v}) for v in range(4000)]
    (tmp_path / "a.dly").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
        assert station_files.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        assert parse(spark, str(tmp_path)).first().TMAX == 3999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_year_and_element_are_filtered_before_the_explode(spark, tmp_path):
    (tmp_path / "a.dly").write_text(line("USW00000001", 2023, 2, "TMAX", {1: 1}) + "\n")
    parsed = station_files.parse_lines(station_files.read_lines(spark, str(tmp_path)))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()  # the scan side comes last
    assert plan.index("Generate posexplode") < plan.index("TMAX,TMIN,PRCP")


def test_forecast_document(spark):
    payload = {"hourly": {"time": ["2024-03-10T02:00", "2024-03-10T03:00"], "temperature_2m": [50.5, None],
                          "relative_humidity_2m": [40, 41], "precipitation": [0.01]}}
    df = spark.createDataFrame([("a", json.dumps(payload)), ("b", "not json")], "station_id string, payload string")
    rows = documents.forecast_hours(df).orderBy("time").collect()
    assert [r.time for r in rows] == [datetime(2024, 3, 10, 2), datetime(2024, 3, 10, 3)]  # wall clock, no DST gap
    assert [r.hour for r in rows] == [2, 3]
    assert (rows[0].temp_f, rows[1].temp_f, rows[0].precip_in, rows[1].precip_in) == (50.5, None, 0.01, None)
    assert rows[0].wind_mph is None
    good, bad = documents.split_bad_documents(df, S.HOURLY_DOCUMENT)
    assert [r.station_id for r in good.collect()] == ["a"] and [r.station_id for r in bad.collect()] == ["b"]
    assert documents.history_hours(df).filter("precip_prob_pct is not null").count() == 0


def test_current_document(spark):
    payload = {"current": {"temperature_2m": 61.2, "wind_speed_10m": 4, "precipitation": 0}}
    df = spark.createDataFrame([("a", json.dumps(payload))], "station_id string, payload string")
    r = documents.current_conditions(df).first()
    assert (r.temp_f, r.wind_mph, r.precip_in, r.humidity_pct) == (61.2, 4.0, 0.0, None)


def feature(event=None, headline=None, severity="Moderate", description="x" * 500, **more):
    return {"properties": dict(event=event, headline=headline, severity=severity, description=description, **more)}


def test_alert_relevance(spark):
    cases = [
        ("Tornado Warning", "", "Extreme", True), ("Tornado Watch", "", "Moderate", True),
        ("Excessive Heat Warning", None, "Moderate", True), ("Special Weather Statement", "", "Severe", True),
        ("Freeze Warning", "", None, True), ("Rip Current Statement", "", "Minor", False),
        ("Rip Current Statement", "HIGH WINDS expected", "Minor", True), (None, None, None, False),
        ("Air Quality Notice", "", "Minor", True),  # "ice" inside a word counts
    ]
    df = spark.createDataFrame(cases, "e string, h string, s string, want boolean")
    got = df.select("want", documents.relevant(F.col("s"), F.col("e"), F.col("h")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_alert_document_order_and_length(spark):
    features = [feature("Wind Advisory", severity="Minor"), feature("Tornado Warning", severity="Extreme", id="t"),
                feature("Rip Current Statement", severity="Minor"), feature("Hail", severity=None, description=None),
                feature("Severe Thunderstorm Warning", severity="Severe")]
    df = spark.createDataFrame([(json.dumps({"features": features}),)], "payload string")
    rows = documents.relevant_alerts(documents.alert_features(df)).orderBy("severity_rank", "position").collect()
    assert [r.severity for r in rows] == ["Extreme", "Severe", "Minor", None]
    assert [len(r.description) for r in rows] == [300, 300, 300, 0]
    assert rows[0].alert_id == "t" and rows[1].alert_id == ""
    assert documents.alert_features(spark.createDataFrame([("{}",)], "payload string")).count() == 0


def test_declared_tables(spark, tmp_path):
    stations = D.stations(spark, "/root/testdata/sf0.001")
    stations.write.parquet(str(tmp_path / "stations"))
    back = tables.declared_table(spark, str(tmp_path), "stations")
    assert back.schema == S.STATIONS and back.count() == stations.count()
    facts = D.daily(spark, "/root/testdata/sf0.001")
    facts.write.parquet(str(tmp_path / "daily_weather"))
    back = tables.declared_table(spark, str(tmp_path), "daily_weather")
    assert back.filter(F.col("score_details.pour")["data"] == "yellow").count() > 0


def test_a_wrong_value_sets_aside_its_hour_only(spark):
    """Each hour is read or set aside, never both and never neither."""
    import json

    hour = lambda n: [f"2024-01-01T{i:02d}:00" for i in range(n)]
    texts = {
        "wrong value": json.dumps({"hourly": {"time": hour(3), "temperature_2m": [50, "abc", 51.5], "wind_speed_10m": [1, 2, None]}}),
        "numbers as text": json.dumps({"hourly": {"time": hour(2), "temperature_2m": ["50", "51"]}}),
        "wrong time": json.dumps({"hourly": {"time": ["noon", *hour(1)], "temperature_2m": [1, 2]}}),
        "nested": json.dumps({"hourly": {"time": hour(2), "temperature_2m": [{"a": 1}, 2]}}),
        "no list": json.dumps({"hourly": {"time": hour(2), "temperature_2m": 5}}),
        "empty object": "{}", "no hours": json.dumps({"hourly": {}}), "text": "no JSON", "null": None, "empty": "",
    }
    docs = spark.createDataFrame(list(texts.items()), "name string, payload string")
    read, aside = {}, {}
    for r in documents.forecast_hours(docs).collect():
        read.setdefault(r["name"], []).append((r["hour"], r["temp_f"]))
    for r in documents.unreadable(docs).collect():
        aside.setdefault(r["name"], []).append(r["position"])
    assert read["wrong value"] == [(0, 50.0), (2, 51.5)] and aside["wrong value"] == [1]
    assert read["numbers as text"] == [(0, 50.0), (1, 51.0)] and "numbers as text" not in aside
    assert read["wrong time"] == [(0, 2.0)] and aside["wrong time"] == [0]
    assert read["nested"] == [(1, 2.0)] and aside["nested"] == [0]
    for name in ("no list", "empty object", "no hours", "text", "null", "empty"):
        assert name not in read and aside[name] == [None], name


def test_freshness_has_four_answers(spark):
    from datetime import datetime, timedelta

    from fieldcast.operators import answers

    now = datetime(2024, 1, 1, 12)
    rows = [("fresh", "forecast", 59), ("fresh", "forecast", 300), ("old", "forecast", 60), ("later", "forecast", -1), ("fresh", "alerts", 1), ("old", "alerts", 9)]
    fetches = spark.createDataFrame([(s, f, now - timedelta(minutes=m)) for s, f, m in rows], "station_id string, feed string, fetched_at timestamp_ntz")
    sites = spark.createDataFrame([(s, s, s) for s in ("fresh", "old", "later", "silent")], "station_id string, name string, covers string")
    alerts = spark.createDataFrame([("old", now - timedelta(minutes=9), 2, "Flood", 1), ("old", now - timedelta(minutes=9), 5, None, 0)], "station_id string, fetched_at timestamp_ntz, seq long, event string, severity_rank int")
    hours = spark.createDataFrame([], "station_id string, fetched_at timestamp_ntz, time timestamp_ntz, hour int, temp_f double, humidity_pct double, dewpoint_f double, precip_prob_pct double, precip_in double, wind_mph double, wind_gust_mph double, cloud_cover_pct double")
    got = {r.station_id: r for r in answers.forecast_answers(sites, fetches, hours, alerts, now).collect()}
    assert [(s, got[s].status, got[s].stale, got[s].alert_state, got[s].alerts) for s in ("fresh", "old", "later", "silent")] == [
        ("fresh", "ok", False, "none", None), ("old", "ok", True, "active", ["", "Flood"]),
        ("later", "unavailable", None, "unknown", None), ("silent", "unavailable", None, "unknown", None),
    ]


def test_declared_tables_refuse_other_types_and_tell_what_differs(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([("a", "n", "c", "s", None, None, None)], S.STATIONS)
    good.write.parquet(f"{root}/stations")
    assert tables.schema_drift(spark, root, ["stations"]).count() == 0
    assert tables.declared_table(spark, root, "stations").schema == S.STATIONS
    jobs = spark.createDataFrame([], S.JOBS)
    jobs.drop("month").withColumn("site", F.lit("x")).write.parquet(f"{root}/jobs")
    assert tables.declared_table(spark, root, "jobs").columns == [f.name for f in S.JOBS]
    got = {(r.column, r.declared, r.found, r.difference) for r in tables.schema_drift(spark, root, ["stations", "jobs"]).collect()}
    assert got == {("month", "string", None, "missing"), ("site", None, "string", "extra")}
    good.select("station_id", F.lit("2020-01-01").alias("observation_date")).write.parquet(f"{root}/daily_weather")
    with pytest.raises(ValueError, match="table daily_weather: observation_date is string, not date"):
        tables.declared_table(spark, root, "daily_weather")


def test_each_document_and_feature_is_read_or_set_aside(spark):
    texts = [
        (1, '{"current":{"temperature_2m":50.5}}'), (2, '{"current":{}}'), (3, '{"current":{"temperature_2m":"warm"}}'), (4, "{}"),
        (5, '{"current":'), (6, None), (7, ""), (8, '{"current":[1]}'), (9, '{"current":{"temperature_2m":"50.5","position":9}}'),
    ]
    df = spark.createDataFrame(texts, "k int, payload string")
    read = {r.k: r.temp_f for r in documents.current_conditions(df).collect()}
    aside = {r.k: (r.position, r.content) for r in documents.unreadable_current(df).collect()}
    assert read == {1: 50.5, 2: None, 9: 50.5}
    assert aside == {k: (None, t) for k, t in texts if k not in read}

    whole = json.dumps({"features": [feature("Hail", id="h")]})
    mixed = '{"features":[{"properties":{"id":"a"}},7,"x",null,{"properties":"none"},[1],{},{"properties":{"id":"b"}}]}'
    alerts = [(1, whole), (2, mixed), (3, '{"features":[]}'), (4, "{}"), (5, '{"features":7}'), (6, "[]"), (7, None), (8, '{"features":[{'), (2, mixed)]
    df = spark.createDataFrame(alerts, "k int, payload string")
    read = sorted((r.k, r.position, r.alert_id) for r in documents.alert_features(df).collect())
    assert read == sorted([(1, 0, "h")] + [(2, 0, "a"), (2, 6, ""), (2, 7, "b")] * 2)
    aside = sorted((r.k, -1 if r.position is None else r.position) for r in documents.unreadable_alerts(df).collect())
    assert aside == sorted([(2, p) for p in (1, 2, 3, 4, 5)] * 2 + [(k, -1) for k in (4, 5, 6, 7, 8)])
    empty = df.limit(0)
    assert documents.alert_features(empty).count() == documents.unreadable_alerts(empty).count() == 0


def test_documents_in_a_stream_with_nothing_or_all_set_aside(spark, tmp_path):
    from fieldcast.streaming import jobs

    root = str(tmp_path)
    schema = "station_id string, payload string"
    for k, text in enumerate(['{"current":{"temperature_2m":1}}', "broken", '{"current":{"temperature_2m":2}}']):
        spark.createDataFrame([(f"s{k}", text)] * 3, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        job = jobs.write_documents(jobs.tail(spark, f"{root}/in", schema, 1), "current", root, f"{root}/progress")
        job.awaitTermination()
        assert job.exception() is None
    counts = {(r.batch, r.part): r.n for r in spark.read.parquet(f"{root}/counts").collect()}
    assert counts == {(0, "read"): 3, (0, "aside"): 0, (1, "read"): 0, (1, "aside"): 3, (2, "read"): 3, (2, "aside"): 0}
    assert spark.read.parquet(f"{root}/read").count() == 6
    assert [r.content for r in spark.read.parquet(f"{root}/aside").collect()] == ["broken"] * 3
