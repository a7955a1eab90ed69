"""Every registered query as (spark, table folder) -> flat DataFrame.

Flat means: decimals as doubles, counts as bigint, factor maps and reason lists as ``|``-joined text, so results
can be compared with any SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grading import factor_text
from ..operators import answers, climate, cure, daily as day_ops, hours, jobs as job_ops, model, pairs, quality, reasons, sealer
from ..schemas import HOURLY_FIELDS
from ..session import path_bytes, remove_path, scratch_dir
from ..sinks import tables
from ..sources import documents, station_files
from ..sources import tables as declared
from ..streaming import alerts as alert_stream
from ..streaming import changes as change_stream
from ..streaming import jobs as streams
from . import derive as D
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY = climate.DAY
DQ_DAY = date(2001, 6, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.MapType):
            c = factor_text(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return _by_year(spark, sf).drop("obs_year")


def _by_year(spark, sf):
    """The daily rows with their partition column, for queries that name a year."""
    return D.fact_table(spark, sf)


def _staged_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return day_ops.stage_jobs(declared.declared_table(spark, D.source_root(spark, sf, "jobs"), "jobs"))


# --- sources and daily rows ------------------------------------------------------------------


@query
def unit_convert(spark, sf):
    return flat(day_ops.convert_units(D.daily_elements(spark, sf)))


@query
def parse_fixed_width(spark, sf):
    lines = station_files.read_lines(spark, D.archive_files(spark, sf))
    values = station_files.parse_lines(lines, first_year=1996)
    return flat(station_files.observations(values))


@query
def daily_scores(spark, sf):
    d = D.daily(spark, sf)
    return flat(
        d.select(
            "*", F.col("score_details.pour").alias("pour_factors"), F.col("score_details.sealer").alias("sealer_factors")
        ).drop("score_details")
    )


@query
def stage_daily(spark, sf):
    return flat(day_ops.stage_daily(_daily(spark, sf)))


@query
def stage_stations(spark, sf):
    return flat(day_ops.stage_stations(declared.declared_table(spark, D.source_root(spark, sf, "stations"), "stations")))


@query
def schema_drift(spark, sf):
    """Tables that came with other columns than declared, and how many rows each of them holds."""
    root = scratch_dir(spark, "drifted")
    D.stations(spark, sf).drop("elevation_m").withColumn("opened", F.lit(1)).write.parquet(f"{root}/stations")
    D.jobs(spark, sf).withColumn("final_revenue", F.col("final_revenue").cast("double")).write.parquet(f"{root}/jobs")
    held = [spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n in ("stations", "jobs")]
    drift = declared.schema_drift(spark, root, ["stations", "jobs"])
    return drift.join(held[0].unionByName(held[1]), "table")


@query
def stage_jobs(spark, sf):
    return flat(
        _staged_jobs(spark, sf).select(
            "job_id", "station_id", "start_date", "completion_date", "job_duration_days", "final_revenue",
            "square_footage", "sealer_coats", "revenue_per_sqft",
        )
    )


# --- analytics -------------------------------------------------------------------------------


@query
def temp_anomalies(spark, sf):
    return flat(climate.temperature_anomalies(_daily(spark, sf), D.stations(spark, sf)))


@query
def wet_dry_streaks(spark, sf):
    return flat(climate.weather_streaks(_daily(spark, sf), D.stations(spark, sf)))


@query
def monthly_viability(spark, sf):
    return flat(climate.seasonal_viability(_daily(spark, sf), D.stations(spark, sf)))


@query
def coverage_audit(spark, sf):
    return flat(climate.coverage_audit(_daily(spark, sf), D.stations(spark, sf)))


@query
def date_spine_gaps(spark, sf):
    return flat(climate.spine_gaps(_daily(spark, sf)))


@query
def year_over_year(spark, sf):
    return flat(climate.year_over_year(_daily(spark, sf), D.stations(spark, sf)))


@query
def best_work_weeks(spark, sf):
    return flat(climate.best_work_weeks(_daily(spark, sf), D.stations(spark, sf)))


@query
def station_pairs(spark, sf):
    return flat(pairs.station_pairs(_daily(spark, sf), D.stations(spark, sf)))


@query
def season_bounds(spark, sf):
    return flat(climate.season_bounds(_daily(spark, sf), D.stations(spark, sf)))


@query
def job_weather(spark, sf):
    return flat(
        job_ops.job_weather(_staged_jobs(spark, sf), _daily(spark, sf), D.stations(spark, sf)).drop("station_id")
    )


@query
def job_days(spark, sf):
    return flat(
        job_ops.job_days(_staged_jobs(spark, sf), _daily(spark, sf)).drop("start_date", "completion_date")
    )


# --- reports ---------------------------------------------------------------------------------


@query
def seasonal_year(spark, sf):
    return flat(reports.seasonal(_by_year(spark, sf), D.stations(spark, sf), year=1999))


@query
def top_streaks(spark, sf):
    return flat(reports.streaks(_daily(spark, sf), D.stations(spark, sf), streak_type="DRY"))


@query
def top_anomalies(spark, sf):
    return flat(reports.anomalies(_daily(spark, sf), D.stations(spark, sf)))


@query
def yearly_change(spark, sf):
    return flat(reports.yearly_change(_daily(spark, sf), D.stations(spark, sf)))


@query
def top_weeks(spark, sf):
    return flat(reports.best_weeks(_daily(spark, sf), D.stations(spark, sf)))


@query
def quality_report(spark, sf):
    return flat(reports.quality(_daily(spark, sf), D.stations(spark, sf)))


@query
def season_report(spark, sf):
    return flat(reports.seasons(_daily(spark, sf), D.stations(spark, sf)))


@query
def pair_report(spark, sf):
    return flat(reports.comparison(_daily(spark, sf), D.stations(spark, sf), "state"))


@query
def job_list(spark, sf):
    listed = reports.job_list(_staged_jobs(spark, sf), _daily(spark, sf), D.stations(spark, sf))
    return flat(listed.drop("station_id"))


@query
def one_job(spark, sf):
    staged, daily = _staged_jobs(spark, sf), _daily(spark, sf)
    chosen = (
        staged.filter(F.col("completion_date").isNotNull() & (F.col("square_footage") % 5 == 4))
        .join(daily.select("station_id", F.col(DAY).alias("start_date")), ["station_id", "start_date"])
        .agg(F.min("job_id"))
        .first()[0]
    )
    return flat(reports.one_job(staged, daily, chosen).drop("start_date", "completion_date"))


@query
def point_lookup(spark, sf):
    daily = _by_year(spark, sf)
    station = D.stations(spark, sf).agg(F.min("station_id")).first()[0]
    day = daily.filter(F.col("station_id") == station).agg(F.min(DAY)).first()[0]
    return flat(reports.point(daily, station, day).drop("obs_year"))


@query
def point_answers(spark, sf):
    """Every job asks for the weather of its first day: by town and date text, some of them unknown or no dates."""
    asked = _staged_jobs(spark, sf).join(D.stations(spark, sf).select("station_id", "name"), "station_id", "left")
    k, day = F.col("job_id"), F.col("start_date")
    form = lambda pattern: F.date_format(day, pattern)
    text = (
        F.when(k % 7 == 1, form("yyyy-M-d")).when(k % 7 == 2, form("yyyy/MM/dd")).when(k % 7 == 3, F.concat(form("yyyy-MM"), F.lit("-31")))
        .when(k % 7 == 4, F.concat(form("yyyy-MM-dd"), F.lit(" "))).when(k % 7 != 5, form("yyyy-MM-dd"))
    )
    requests = asked.select(k.alias("request_id"), F.when(k % 11 == 0, "Nowhere").otherwise(F.col("name")).alias("town"), text.alias("date"))
    return flat(
        reports.points_by_text(requests, D.stations(spark, sf), _daily(spark, sf)).select(
            "request_id", "town", "date", "status", "temp_max_f", "temp_min_f", "temp_mean_f", "precip_in", "snow_in",
            "wind_avg_mph", "wind_max_mph", "pour_score", "sealer_score",
        )
    )


# --- hours -----------------------------------------------------------------------------------


def _spoilt_forecasts(spark, sf):
    site = F.substring("station_id", 2, 10).cast("int")
    text = F.when(site % 11 == 0, F.substring("payload", 1, 40)).when(
        site % 7 == 0, F.regexp_replace("payload", '"time":\\["[^"]*"', '"time":["half past nine"')
    )
    return D.forecast_documents(D.hourly(spark, sf)).withColumn("payload", F.coalesce(text, "payload"))


@query
def stream_quarantine(spark, sf):
    """Streams of all three kinds of documents, some of them cut off, some with an entry that cannot be read: rows per kind
    that were read and set aside, as stored and as counted on the way."""
    current = _current_documents(spark, sf)
    text = F.when(F.col("seq") % 11 == 0, F.substring("payload", 1, 30)).when(
        F.col("seq") % 7 == 0, F.lit('{"current":{"temperature_2m":50.5,"wind_gusts_10m":"strong"}}')
    )
    warned = D.alert_documents(D.alerts(spark, sf))
    listed = F.when(F.col("document_id") % 11 == 0, F.lit("[]")).when(
        F.col("document_id") % 7 == 0, F.regexp_replace("payload", '"features":\\[', '"features":[7,"x",null,')
    )
    given = {
        "forecast": _spoilt_forecasts(spark, sf),
        "current": current.withColumn("payload", F.coalesce(text, "payload")),
        "alerts": warned.withColumn("payload", F.coalesce(listed, "payload")),
    }
    run = scratch_dir(spark, "documents-run")
    files = landing_files(spark, sf)
    out = None
    for kind, rows in given.items():
        rows.repartition(2 * files).write.parquet(f"{run}/{kind}/in")
        stream = streams.tail(spark, f"{run}/{kind}/in", rows.schema, files)
        job = streams.write_documents(stream, kind, f"{run}/{kind}", f"{run}/{kind}/progress")
        counts = _finish(job, f"{run}/{kind}/counts").groupBy().pivot("part", ["read", "aside"]).agg(F.sum("n"))
        aside = spark.read.parquet(f"{run}/{kind}/aside").agg(
            F.count_if(F.col("position").isNull()).alias("documents_aside"), F.count("position").alias("entries_aside")
        )
        stored = spark.read.parquet(f"{run}/{kind}/read").agg(F.count(F.lit(1)).alias("entries_read"))
        one = stored.select(F.lit(kind).alias("kind"), "*", aside.select("documents_aside").scalar().alias("documents_aside"),
                            aside.select("entries_aside").scalar().alias("entries_aside"),
                            counts.select("read").scalar().alias("counted_read"), counts.select("aside").scalar().alias("counted_aside"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def quarantine(spark, sf):
    """Every eleventh site sends text that is no JSON, every seventh a first hour that is no time: what is read and what
    is set aside, per site."""
    given = _spoilt_forecasts(spark, sf)
    read = documents.forecast_hours(given).groupBy("station_id").agg(F.count("*").alias("hours_read"))
    aside = documents.unreadable(given).groupBy("station_id").agg(
        F.count(F.when(F.col("position").isNull(), 1)).alias("broken_documents"), F.count("position").alias("broken_hours")
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return read.join(aside, "station_id", "full").select("station_id", n("hours_read"), n("broken_documents"), n("broken_hours"))


@query
def rolling_half_hours(spark, sf):
    """Readings every half hour, in blocks shorter than a site's day: the past is a span of time, not a number of rows."""
    hourly = D.hourly(spark, sf)
    shifted = hourly.withColumn("time", F.col("time") + F.expr("INTERVAL 30 MINUTES"))
    return flat(sealer.rolling_site_inputs(hourly.unionByName(shifted), block_rows=30).select("station_id", "time", "rain_last_24h", "temp_low_f", "temp_high_f"))


@query
def flatten_forecast(spark, sf):
    return flat(documents.forecast_hours(D.forecast_documents(D.hourly(spark, sf))))


@query
def flatten_history(spark, sf):
    return flat(documents.history_hours(D.forecast_documents(D.hourly(spark, sf))))


@query
def hourly_pour(spark, sf):
    return flat(hours.score_pour(D.hourly(spark, sf)).select("station_id", "time", "pour_score", "pour_factors"))


def _days(spark, sf):
    return hours.by_day(hours.score_pour(D.hourly(spark, sf)))


@query
def day_verdicts(spark, sf):
    return flat(hours.day_verdicts(_days(spark, sf)))


@query
def best_window(spark, sf):
    return flat(hours.best_windows(_days(spark, sf)))


@query
def best_window_overall(spark, sf):
    ahead = hours.upcoming(D.hourly(spark, sf), D.AS_OF)
    return flat(hours.best_overall(hours.best_windows(hours.by_day(hours.score_pour(ahead)))))


@query
def outlook_days(spark, sf):
    ahead = hours.upcoming(D.hourly(spark, sf), D.AS_OF)
    detail = hours.detail_dates(ahead, D.AS_OF).withColumn("d", F.lit(True))
    dates = ahead.select("station_id", F.col("time").cast("date").alias("date")).distinct()
    return dates.join(detail, ["station_id", "date"], "left").select(
        "station_id", "date", F.col("d").isNull().alias("outlook")
    )


@query
def day_reasons(spark, sf):
    return flat(reasons.day_summaries(D.hourly(spark, sf), D.AS_OF))


@query
def rolling_site_inputs(spark, sf):
    return flat(sealer.rolling_site_inputs(D.hourly(spark, sf)))


@query
def hourly_sealer(spark, sf):
    scored = hours.score_sealer(sealer.rolling_site_inputs(D.hourly(spark, sf)))
    return flat(scored.select("station_id", "time", "sealer_score", "sealer_factors"))


@query
def sealer_reasons(spark, sf):
    scored = sealer.explain(hours.score_sealer(sealer.rolling_site_inputs(D.hourly(spark, sf))))
    return flat(scored.select("station_id", "time", "sealer_score", "verdict", "reasons", "details"))


@query
def sealer_check(spark, sf):
    hourly = D.hourly(spark, sf)
    return flat(sealer.sealer_check(hourly, hourly, D.AS_OF, D.stations(spark, sf)).drop("sealer_factors"))


@query
def cure_window(spark, sf):
    return flat(cure.rolling_cure(D.hourly(spark, sf)))


@query
def cure_check(spark, sf):
    return flat(cure.cure_check(D.hourly(spark, sf), D.AS_OF, D.stations(spark, sf)))


# --- alerts, streams, snapshots --------------------------------------------------------------


@query
def alert_filter(spark, sf):
    return flat(documents.relevant_alerts(D.alerts(spark, sf)).drop("ts"))


@query
def parse_alerts(spark, sf):
    features = documents.alert_features(D.alert_documents(D.alerts(spark, sf)))
    return flat(
        documents.relevant_alerts(features).select(
            "alert_id", "event", "headline", "severity", "areas", "onset", "description", "severity_rank"
        )
    )


PUBLISHED = ["alert_id", "arrived", "seq", "event", "severity", "description"]


@query
def alert_dedup(spark, sf):
    return flat(alert_stream.dedup_batch(D.alerts(spark, sf)).select(*PUBLISHED))


LANDING_FILES = 4
#: Bytes of the events table behind one landing file of a slice.
LANDING_SHARE = 1024 * 1024


def landing_files(spark: SparkSession, sf: str, least: int = 1) -> int:
    """Landing files of a slice: ``least`` while the table is small, then in proportion to it, so that the share of the
    task that writes or reads one does not grow with the table."""
    return max(least, -(-path_bytes(spark, f"{sf}/events.parquet") // LANDING_SHARE))


def landed(df: DataFrame, name: str, slices: int = 4, files: int = LANDING_FILES) -> tuple[str, T.StructType]:
    """Writes a finished table as landing files in arrival order: one time slice after the other, each in ``files``
    files, so a stream that takes ``files`` per trigger sees one slice per micro-batch."""
    path = scratch_dir(df.sparkSession, name)
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / slices
    edge = lambda i: F.lit((first + step * i).isoformat(sep=" ")).cast("timestamp_ntz")
    for i in range(slices):
        inside = (F.col("ts") >= edge(i)) & (F.col("ts") < edge(i + 1) if i + 1 < slices else F.lit(True))
        df.filter(inside).repartition(files).write.mode("append").parquet(path)
    return path, df.schema


def _finish(stream_query, path: str) -> DataFrame:
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()
    return SparkSession.active().read.parquet(path)


@query
def stream_alerts(spark, sf):
    files = landing_files(spark, sf, LANDING_FILES)
    path, schema = landed(D.alerts(spark, sf), "alerts-in", files=files)
    run = scratch_dir(spark, "alerts-run")
    stream = streams.tail(spark, path, schema, files)
    return flat(_finish(streams.write_published(stream, f"{run}/out", f"{run}/state", f"{run}/progress"), f"{run}/out").select(*PUBLISHED))


CHANGE = ["station_id", "ts", "seq", "pour_score", "previous_score", "score_changed"]


def _scored_readings(spark, sf):
    return change_stream.score_readings(D.readings(spark, sf)).drop("pour_factors")


@query
def verdict_changes(spark, sf):
    return flat(change_stream.changes_batch(_scored_readings(spark, sf)).select(*CHANGE))


@query
def stream_changes(spark, sf):
    files = landing_files(spark, sf, LANDING_FILES)
    path, schema = landed(D.readings(spark, sf), "readings-in", files=files)
    run = scratch_dir(spark, "readings-run")
    scored = change_stream.score_readings(streams.tail(spark, path, schema, files)).drop("pour_factors")
    return flat(_finish(streams.write_changes(scored, f"{run}/out", f"{run}/state", f"{run}/progress"), f"{run}/out").select(*CHANGE))


@query
def stream_restart(spark, sf):
    """The change stream when the driver dies in its last batch: that batch's output, state and commit are lost, the batch is
    run again from the offsets that were planned for it, and what arrived meanwhile follows."""
    files = landing_files(spark, sf)
    path, schema = landed(D.readings(spark, sf).filter("seq % 3 <> 0"), "restart-in", 3, files)
    run = scratch_dir(spark, "restart-run")

    def attempt() -> DataFrame:
        scored = change_stream.score_readings(streams.tail(spark, path, schema, files)).drop("pour_factors")
        return _finish(streams.write_changes(scored, f"{run}/out", f"{run}/state", f"{run}/progress"), f"{run}/out")

    last = attempt().agg(F.max("batch")).first()[0]
    for lost in (f"out/batch={last}", f"state/version={last}", f"progress/commits/{last}", f"progress/commits/.{last}.crc"):
        remove_path(spark, f"{run}/{lost}")
    later = D.readings(spark, sf).filter("seq % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    later.repartition(files).write.mode("append").parquet(path)
    return flat(attempt().select(*CHANGE))


@query
def live_updates(spark, sf):
    changed = change_stream.changes_batch(_scored_readings(spark, sf))
    return change_stream.live_updates(changed).select("station_id", "ts", "payload")


@query
def live_alerts(spark, sf):
    return alert_stream.live_alerts(alert_stream.dedup_batch(D.alerts(spark, sf))).drop("seq")


@query
def weather_log(spark, sf):
    return change_stream.weather_messages(change_stream.changes_batch(change_stream.score_readings(D.readings(spark, sf))))


@query
def bounded_log(spark, sf):
    """The log of alerts after four micro-batches, the last two of them behind a restart."""
    files = landing_files(spark, sf)
    alerts = D.alerts(spark, sf).select("ts", "seq", "alert_id", "event")
    path, schema = landed(alerts, "log-in", 4, files)
    run = scratch_dir(spark, "log-run")
    for _ in range(2):
        stream = streams.tail(spark, path, schema, 2 * files)
        job = streams.write_bounded_log(stream, "alerts", f"{run}/log", f"{run}/progress")
        job.awaitTermination()
        if job.exception():
            raise job.exception()
        landed_again = alerts.withColumns({"seq": F.col("seq") + 10_000_000, "ts": F.col("ts") - F.expr("INTERVAL 36 HOURS")})
        landed_again.repartition(2 * files).write.mode("append").parquet(path)
    return flat(streams.bounded_log(spark, f"{run}/log"))


def _current_documents(spark, sf):
    names = {n: f for n, f in HOURLY_FIELDS.items() if n != "precip_prob_pct"}
    document = F.struct(F.struct(*[F.col(n).alias(f) for n, f in names.items()]).alias("current"))
    return D.readings(spark, sf).select("station_id", "ts", "seq", F.to_json(document).alias("payload"))


@query
def current_conditions(spark, sf):
    """Readings written as current-conditions documents and read back."""
    return flat(documents.current_conditions(_current_documents(spark, sf)))


@query
def tail_streams(spark, sf):
    """Both live logs tailed as one stream."""
    weather, warn = live_updates(spark, sf).select("ts", "payload"), live_alerts(spark, sf).select("ts", "payload")
    files = landing_files(spark, sf, LANDING_FILES)
    paths = {n: landed(rows, f"{n}-in", 2, files)[0] for n, rows in (("weather", weather), ("alerts", warn))}
    run = scratch_dir(spark, "tail-run")
    merged = streams.tail_many(spark, paths, weather.schema, files)
    return _finish(streams.write_files(merged, f"{run}/out", f"{run}/progress"), f"{run}/out")


@query
def last_known(spark, sf):
    return flat(
        tables.last_known(_scored_readings(spark, sf), ["pour_score", "temp_f", "humidity_pct", "wind_mph"])
    )


@query
def keep_latest_n(spark, sf):
    order = [F.col("ts").desc(), F.col("seq").desc()]
    kept = tables.latest_rows(_scored_readings(spark, sf), 100, order, ["station_id"])
    return flat(kept.select("station_id", "ts", "seq", "pour_score"))


@query
def stream_health(spark, sf):
    changed = change_stream.changes_batch(_scored_readings(spark, sf))
    logs = {
        "weather": streams.trim_log(change_stream.live_updates(changed), "weather"),
        "alerts": streams.trim_log(alert_stream.live_alerts(alert_stream.dedup_batch(D.alerts(spark, sf))), "alerts"),
    }
    return flat(streams.stream_health(logs))


def _feeds(spark, sf):
    """What was fetched around AS_OF, and when: sites fetch at different moments, some feeds of some sites never. Each
    forecast was fetched once before, without temperatures; the alerts of a site are those of the day, for one in three."""
    hourly = D.hourly(spark, sf)
    number = F.substring("station_id", 2, 10).cast("bigint")
    seen = hourly.select("station_id", number.alias("k")).distinct()
    ago = lambda minutes: hours.wall_clock(D.AS_OF) - F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    k = F.col("k")
    feed = lambda name, rows, minutes: rows.select("station_id", F.lit(name).alias("feed"), ago(minutes).alias("fetched_at"))
    forecast = seen.filter(k % 13 != 0)
    fetches = feed("forecast", forecast, k % 5 * 20).unionByName(feed("forecast", forecast, k % 5 * 20 + 180))
    fetches = fetches.unionByName(feed("history", seen, k % 4 * 10)).unionByName(feed("alerts", seen.filter(k % 7 != 0), k % 4 * 2))
    fetches = fetches.unionByName(feed("forecast", forecast, F.lit(-30)))  # later than AS_OF: not known yet
    rows = hourly.join(fetches.filter("feed = 'forecast'").drop("feed"), "station_id")
    old = F.col("fetched_at") < ago(number % 5 * 20)
    rows = rows.withColumn("temp_f", F.when(~old, F.col("temp_f")))
    warned = documents.relevant_alerts(D.alerts(spark, sf)).filter(F.col("ts").cast("date") == F.lit(D.AS_OF.date()))
    site = F.regexp_extract("areas", "([0-9]+)", 1).cast("bigint")
    warned = warned.select(D.station_key(site).alias("station_id"), site.alias("k"), "seq", "event", "severity_rank").filter(k % 3 == 0)
    warned = warned.withColumn("fetched_at", ago(k % 4 * 2)).drop("k")
    return fetches, rows, warned


@query
def forecast_answer(spark, sf):
    fetches, rows, warned = _feeds(spark, sf)
    return flat(answers.forecast_answers(D.stations(spark, sf), fetches, rows, warned, D.AS_OF))


@query
def cure_answer(spark, sf):
    """The curing decision with its freshness, over the newest forecast of each listed site."""
    fetches, rows, _ = _feeds(spark, sf)
    fresh = answers.freshness(fetches, D.AS_OF)
    sites = D.stations(spark, sf)
    newest = answers.newest_rows(rows, fresh, "forecast").drop("fetched_at").join(sites.select("station_id"), "station_id", "left_semi")
    decided = cure.cure_check(newest, D.AS_OF, sites).select("station_id", "hours", "score", "verdict")
    return flat(answers.with_freshness(decided, sites, fresh, ["forecast", "history"]))


@query
def latest_snapshot(spark, sf):
    rows = streams.latest_snapshots(D.snapshots(spark, sf), datetime(2024, 1, 15, 9, 0))
    stamp = F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")
    return flat(rows.select("station_id", "forecast_hour", "temp_f", "pour_score", stamp, "stale"))


# --- table maintenance -----------------------------------------------------------------------


@query
def upsert_daily(spark, sf):
    """A stored table, corrections for its late years and one new day per station."""
    base = _daily(spark, sf).withColumn("obs_year", F.year(DAY))
    path = f"{scratch_dir(spark, 'daily')}/daily_weather"
    tables.create_table(base, path, "obs_year", tables.DAILY_KEY)
    stored = spark.read.schema(base.schema).parquet(path)
    corrected = stored.filter(
        (F.col("obs_year") >= 2000) & F.substring("station_id", 11, 1).isin("1", "4", "7")
    ).withColumn("temp_max_f", F.lit(1.5).cast("decimal(5,1)"))
    added = D.stations(spark, sf).select(
        "station_id",
        F.lit(date(2002, 6, 1)).alias(DAY),
        F.lit(70).cast("decimal(5,1)").alias("temp_max_f"),
        *[F.lit(None).cast(base.schema[m].dataType).alias(m) for m in day_ops.MEASURES[1:]],
        F.lit("yellow").alias("pour_score"),
        F.lit(None).cast("string").alias("sealer_score"),
        F.lit(2002).alias("obs_year"),
    )
    tables.upsert(spark, path, corrected.unionByName(added), tables.DAILY_KEY, "obs_year")
    return flat(spark.read.schema(base.schema).parquet(path).drop("obs_year"))


def _snapshot_view(df: DataFrame) -> DataFrame:
    stamp = F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")
    return flat(df.select("station_id", "forecast_hour", stamp, "pour_score"))


@query
def append_new(spark, sf):
    """Two fetches stored, then all three offered twice: only the third is new."""
    rows = D.snapshots(spark, sf)
    path = f"{scratch_dir(spark, 'snapshots')}/weather_forecasts"
    first = rows.filter(F.col("fetched_at") < F.lit("2024-01-15 09:00:00").cast("timestamp"))
    tables.create_table(first, path, "fetched_date", tables.SNAPSHOT_KEY)
    tables.append_absent(spark, path, rows.unionByName(rows), tables.SNAPSHOT_KEY, "fetched_date")
    return _snapshot_view(spark.read.schema(rows.schema).parquet(path))


@query
def retention(spark, sf):
    rows = D.snapshots(spark, sf)
    path = f"{scratch_dir(spark, 'snapshots')}/weather_forecasts"
    tables.create_table(rows, path, "fetched_date", tables.SNAPSHOT_KEY)
    tables.expire(spark, path, rows.schema, datetime(2024, 1, 22, 9, 20))
    return _snapshot_view(spark.read.schema(rows.schema).parquet(path))


def _exported(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'export')}/{name}"
    tables.export_table(table, name, path)
    return flat(spark.read.schema(tables.export_columns(table, name).schema).parquet(path))


@query
def export_daily(spark, sf):
    return _exported(spark, _daily(spark, sf), "daily_weather")


@query
def export_stations(spark, sf):
    return _exported(spark, D.stations(spark, sf), "stations")


@query
def export_jobs(spark, sf):
    return _exported(spark, D.jobs(spark, sf), "jobs")


# --- checks ----------------------------------------------------------------------------------


@query
def dq_report(spark, sf):
    """All rules over the sources and the marts, each mart stored before it is checked."""
    daily, stations, jobs = _daily(spark, sf), D.stations(spark, sf), _staged_jobs(spark, sf)
    marts = {
        "coverage": lambda: climate.coverage_audit(daily, stations),
        "seasons": lambda: climate.season_bounds(daily, stations),
        "job_weather": lambda: job_ops.job_weather(jobs, daily, stations),
        "year_over_year": lambda: climate.year_over_year(daily, stations),
    }
    root = scratch_dir(spark, "marts")
    # the marts do not depend on each other: their jobs share the cluster
    with ThreadPoolExecutor(len(marts)) as pool:
        store = inheritable_thread_target(spark)(lambda name: tables.materialise(marts[name](), name, "mart", root))
        stored = dict(zip(marts, pool.map(store, marts)))
    checked = {"stations": stations, "daily": daily, "jobs": jobs, **stored}
    return flat(quality.run_checks(checked, quality.standard_rules(DQ_DAY)))


@query
def jobs_without_weather(spark, sf):
    return flat(quality.jobs_without_weather(_staged_jobs(spark, sf), _daily(spark, sf)))


@query
def future_observations(spark, sf):
    return flat(quality.future_observations(_daily(spark, sf), DQ_DAY))


@query
def unrealistic_temperatures(spark, sf):
    return flat(quality.unrealistic_temperatures(_daily(spark, sf), 30, 100))


# --- model -----------------------------------------------------------------------------------


def _features(spark, sf):
    return model.split_in_order(model.features(model.training_rows(_daily(spark, sf))))


@query
def model_features(spark, sf):
    return _features(spark, sf).withColumn("temp_range", F.round("temp_range", 6))


def _training(spark, sf):
    return _features(spark, sf).filter("is_train")


@query
def model_moments(spark, sf):
    """Of the training rows alone, as the model uses them."""
    stats = model.moments(_training(spark, sf))
    rows = [(name, mean, deviation) for name, (mean, deviation) in stats.items()]
    held = spark.createDataFrame(rows, "feature string, mean double, deviation double")
    return held.select("feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query
def model_inputs(spark, sf):
    """All rows in units of the training rows' deviation."""
    scaled = model.standardise(_features(spark, sf), model.moments(_training(spark, sf)))
    return scaled.select("station_id", "observation_date", "is_train", *[F.round(f"z_{f}", 6).alias(f"z_{f}") for f in model.FEATURES])


@query
def model_report(spark, sf):
    rows = _features(spark, sf)
    fitted = model.train(rows.filter("is_train"))
    return model.report(fitted, fitted.score(rows))


@query
def model_scores(spark, sf):
    rows = _features(spark, sf)
    return model.train(rows.filter("is_train")).score(rows)
