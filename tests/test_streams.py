"""Streams over several micro-batches against their batch twins and against plain loops."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldcast.plans import derive as D
from fieldcast.plans.catalogue import CHANGE, landed
from fieldcast.session import scratch_dir
from fieldcast.streaming import alerts as A
from fieldcast.streaming import changes as C
from fieldcast.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def same(a, b):
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_changes_over_batches(spark):
    path, schema = landed(D.readings(spark, SF), "in", 5, 2)
    stream = C.changes_stream(C.score_readings(J.tail(spark, path, schema, 2)).drop("pour_factors")).select(*CHANGE)
    out = scratch_dir(spark, "out")
    query = J.write_files(stream, out, scratch_dir(spark, "cp"))
    finish(query)
    assert query.lastProgress["batchId"] >= 4
    batch = C.changes_batch(C.score_readings(D.readings(spark, SF)).drop("pour_factors"), 7).select(*CHANGE)
    same(spark.read.parquet(out), batch)
    assert batch.filter("pour_score = 'green'").count() == 0  # no rain probability, never green
    assert batch.filter("score_changed").count() > 0


def test_changes_by_batch_jobs(spark, tmp_path):
    path, schema = landed(D.readings(spark, SF), "in", 5, 2)
    scored = C.score_readings(J.tail(spark, path, schema, 2)).drop("pour_factors")
    query = J.write_changes(scored, *[str(tmp_path / n) for n in ("out", "state", "cp")])
    finish(query)
    assert query.lastProgress["batchId"] >= 4
    batch = C.changes_batch(C.score_readings(D.readings(spark, SF)).drop("pour_factors"))
    same(spark.read.parquet(str(tmp_path / "out")).select(*CHANGE), batch.select(*CHANGE))


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    landing, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = D.readings(spark, SF)
    for part in ("seq < 500", "seq >= 500"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(landing)
        scored = C.score_readings(J.tail(spark, landing, rows.schema)).drop("pour_factors")
        finish(J.write_files(C.changes_stream(scored).select(*CHANGE), out, cp))
    same(spark.read.parquet(out), C.changes_batch(C.score_readings(rows).drop("pour_factors")).select(*CHANGE))


def test_change_rule(spark):
    rows = [("a", i, s) for i, s in enumerate(["green", None, "green", "red", "red"])]
    df = spark.createDataFrame(rows, "station_id string, seq int, pour_score string").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = C.changes_batch(df).orderBy("seq").collect()
    assert [r.score_changed for r in got] == [False, True, False, True, False]


def loop(arrivals, ttl):
    seen, out = {}, []
    for t, seq, i in sorted(arrivals):
        if i not in seen or t - seen[i] >= ttl:
            seen[i] = t
            out.append((i, t, seq))
    return sorted(out)


@pytest.fixture(scope="module")
def repeats(spark):
    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    rows, arrivals = [], []
    for seq in range(3000):
        i = "" if seq % 3 == 0 else f"id{rnd.randint(0, 30)}"  # a third of all alerts share one id
        t = rnd.randint(0, 400)
        rows.append((i, "Flood Watch", None, None, "text", start + timedelta(seconds=t), seq))
        arrivals.append((int((start - datetime(1970, 1, 1)).total_seconds()) + t, seq, i))
    df = spark.createDataFrame(
        rows, "alert_id string, event string, headline string, severity string, description string, ts timestamp_ntz, seq int")
    return df, arrivals


def test_dedup_equals_a_loop(spark, repeats):
    df, arrivals = repeats
    got = sorted((r.alert_id, r.arrived, r.seq) for r in A.dedup_batch(df.repartition(6), ttl=60).collect())
    assert got == loop(arrivals, 60)


@pytest.mark.parametrize("ttl,fan,seeded", [(60, 3, False), (150, 2, True)])
def test_publications_equal_a_loop_at_every_depth(spark, ttl, fan, seeded):
    rnd = random.Random(ttl)
    keys = sorted({("" if k % 2 else f"id{rnd.randrange(6)}", rnd.randrange(-50, 400)) for k in range(600)})
    before = {"": -55, "id1": 40, "gone": 3} if seeded else {}
    state = spark.createDataFrame(list(before.items()), "alert_id string, last_published long") if seeded else None
    got = A.publications(spark.createDataFrame(keys, "alert_id string, arrived long"), ttl, state, fan).collect()
    want, seen = [], dict(before)
    for i, t in sorted(keys, key=lambda k: k[1]):
        if i not in seen or t - seen[i] >= ttl:
            seen[i] = t
            want.append((i, t))
    assert sorted(map(tuple, got)) == sorted(want)


def test_an_id_with_half_of_all_rows_is_spread(spark):
    """Half of the alerts share one id for 400 days: no stretch of it, and so no task, holds an eighth of the rows."""
    day = 86_400
    hot = spark.range(60_000).select(F.lit("hot").alias("alert_id"), (F.col("id") * (400 * day // 60_000)).alias("arrived"))
    cold = spark.range(60_000).select(F.concat(F.lit("id"), (F.col("id") % 5_000).cast("string")).alias("alert_id"), (F.col("id") * 577 % (400 * day)).alias("arrived"))
    keys = hot.unionByName(cold).distinct()
    group = F.floor(F.col("arrived") / (A.R.ALERT_TTL_SECONDS * A.FAN))
    spread = A._spread(keys.withColumn("g", group), "g", "arrived").repartition(64, "alert_id", "g")
    most = spread.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]
    assert most <= keys.count() / 8
    published = A.publications(keys).filter("alert_id = 'hot'").orderBy("arrived").collect()
    seconds = [r.arrived for r in hot.orderBy("arrived").collect()]
    want, last = [], None
    for t in seconds:
        if last is None or t - last >= day:
            want.append(t)
            last = t
    assert [r.arrived for r in published] == want


def test_no_alerts_publish_nothing(spark):
    none = spark.createDataFrame([], "alert_id string, arrived long")
    assert A.publications(none).collect() == []


def test_dedup_stream_equals_a_loop(spark, repeats):
    df, arrivals = repeats
    path, schema = landed(df, "alerts", 6, 1)
    out = scratch_dir(spark, "out")
    finish(J.write_files(A.dedup_stream(J.tail(spark, path, schema, 1), ttl=60), out, scratch_dir(spark, "cp")))
    got = sorted((r.alert_id, r.arrived, r.seq) for r in spark.read.parquet(out).collect())
    assert got == loop(arrivals, 60)


def test_dedup_by_batch_jobs_equals_a_loop(spark, repeats, tmp_path):
    df, arrivals = repeats
    path, schema = landed(df, "alerts", 6, 2)
    query = J.write_published(
        J.tail(spark, path, schema, 2), *[str(tmp_path / n) for n in ("out", "state", "cp")], ttl=60)
    finish(query)
    assert query.lastProgress["batchId"] >= 5
    got = sorted((r.alert_id, r.arrived, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == loop(arrivals, 60)
    held = spark.read.parquet(str(tmp_path / "state" / "version=5"))
    newest = max(t for t, _, _ in arrivals)
    assert held.count() == held.filter(F.col("last_published") + 60 > newest).count() > 0


def test_irrelevant_alerts_do_not_mark_an_id(spark):
    rows = [("x", "Rip Current Statement", "", "Minor", "", datetime(2024, 1, 1), 0),
            ("x", "Flood Watch", "", "Minor", "d" * 900, datetime(2024, 1, 1, 1), 1)]
    df = spark.createDataFrame(
        rows, "alert_id string, event string, headline string, severity string, description string, ts timestamp_ntz, seq int")
    got = A.dedup_batch(df).collect()
    assert [r.seq for r in got] == [1] and len(got[0].description) == 500


def test_watermark_form_runs(spark):
    path, schema = landed(D.alerts(spark, SF), "alerts", 3, 1)
    out = scratch_dir(spark, "out")
    stream = A.dedup_stream_watermark(J.tail(spark, path, schema, 1)).select("alert_id", "seq")
    finish(J.write_files(stream, out, scratch_dir(spark, "cp")))
    exact = A.dedup_batch(D.alerts(spark, SF))
    got = spark.read.parquet(out)
    assert 0 < got.count() <= exact.count()
    assert got.select("alert_id").distinct().count() == exact.select("alert_id").distinct().count()


def test_two_logs_as_one_stream(spark):
    readings, alerts = D.readings(spark, SF), D.alerts(spark, SF)
    weather = C.live_updates(C.changes_batch(C.score_readings(readings))).select("ts", "seq", "payload")
    warn = A.live_alerts(A.dedup_batch(alerts)).select("ts", "seq", "payload")
    paths = {"weather": landed(weather, "weather", 2)[0], "alerts": landed(warn, "alerts", 2)[0]}
    out = scratch_dir(spark, "out")
    finish(J.write_files(J.tail_many(spark, paths, weather.schema), out, scratch_dir(spark, "cp")))
    merged = spark.read.parquet(out)
    assert {(r.stream, r["count"]) for r in merged.groupBy("stream").count().collect()} == {
        ("weather", weather.count()), ("alerts", warn.count())}
    payload = json.loads(merged.filter("stream = 'weather'").first().payload)
    assert payload["type"] == "weather_update" and isinstance(payload["score_changed"], bool)
    payload = json.loads(merged.filter("stream = 'alerts'").first().payload)
    assert list(payload) == ["type", "event", "headline", "severity", "areas", "onset", "expires"]
    health = {r.stream: r.entries for r in J.stream_health({"weather": weather, "alerts": warn}).collect()}
    assert health == {"weather": weather.count(), "alerts": warn.count()}


def test_last_known_table(spark, tmp_path):
    rows = C.score_readings(D.readings(spark, SF)).select("station_id", "ts", "pour_score", "temp_f")
    path, schema = landed(rows, "scored", 4, 1)
    finish(J.write_last_known(J.tail(spark, path, schema, 1), str(tmp_path / "t"), str(tmp_path / "cp"), ["pour_score", "temp_f"]))
    versions = sorted((tmp_path / "t").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    from fieldcast.sinks.tables import last_known

    same(spark.read.parquet(str(versions[-1])), last_known(rows, ["pour_score", "temp_f"]))


def test_log_messages_are_text(spark):
    changed = C.changes_batch(C.score_readings(D.readings(spark, SF)))
    log = C.weather_messages(changed)
    assert {t for _, t in log.dtypes} == {"string"}
    assert log.filter("temp_f = ''").count() == changed.filter("temp_f is null").count() > 0
    kept = J.trim_log(changed, "alerts", per_station=True)
    assert kept.groupBy("station_id").count().agg(F.max("count")).first()[0] <= 100
    assert J.trim_log(changed, "alerts").count() == 100
