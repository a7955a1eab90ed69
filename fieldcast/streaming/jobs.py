"""Starting and running the streams: sources, triggers, sinks, health.

Progress lives in the checkpoint folder, so a restarted query resumes behind the last finished batch; the Parquet
file sink makes the output exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import rules as R
from ..functions.times import seconds_since_1970
from ..operators.hours import wall_clock
from ..session import clear_scratch, remove_path, scratch_mark
from ..sinks.tables import last_known, latest_rows
from ..sources.documents import KINDS
from .alerts import dedup_batch, still_held
from .changes import changes_batch, last_verdicts

WEATHER_POLL = "15 minutes"
ALERT_POLL = "5 minutes"
KEPT_MESSAGES = {"weather": 1000, "alerts": 100}
TAIL_FILES = 10
KEPT_VERSIONS = 2


def tail(spark: SparkSession, path: str, schema, files_per_batch: int = TAIL_FILES) -> DataFrame:
    """New files of a landing folder, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tail_many(spark: SparkSession, paths: dict[str, str], schema, files_per_batch: int = TAIL_FILES) -> DataFrame:
    """Several landing folders as one stream, each row labelled with its ``stream``."""
    streams = [tail(spark, p, schema, files_per_batch).withColumn("stream", F.lit(n)) for n, p in paths.items()]
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def write_files(
    stream: DataFrame, path: str, checkpoint: str, poll: str | None = None
) -> StreamingQuery:
    """Appends a stream to a Parquet folder: every ``poll``, or once over everything available."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def _stepwise(
    stream: DataFrame, step: Callable[[DataFrame, DataFrame | None, Callable[[DataFrame], DataFrame]], DataFrame],
    state: str, checkpoint: str, poll: str | None, out: str | None = None,
) -> StreamingQuery:
    """Runs ``step(batch, state before, put) -> state after`` on every micro-batch. ``put`` writes the batch's output
    and gives it back as stored, so that the state can be taken from it without evaluating it again.

    Output and state go to a folder named after the batch and are overwritten, so a batch that is run again after
    a failure leaves the same files: the result is exactly-once. Two versions of the state are kept.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = scratch_mark()
        batch.persist()
        try:
            before = None
            if batch_id:
                before = spark.read.parquet(f"{state}/version={batch_id - 1}")

            def put(output: DataFrame) -> DataFrame:
                path = f"{out}/batch={batch_id}"
                output.write.mode("overwrite").parquet(path)
                return spark.read.schema(output.schema).parquet(path)

            step(batch, before, put).write.mode("overwrite").parquet(f"{state}/version={batch_id}")
        finally:
            batch.unpersist()
            clear_scratch(spark, mark)
        # a batch is run again from the version before it; older ones are of no use
        if batch_id >= KEPT_VERSIONS:
            remove_path(spark, f"{state}/version={batch_id - KEPT_VERSIONS}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_last_known(
    stream: DataFrame, path: str, checkpoint: str, fields: list[str], poll: str | None = None
) -> StreamingQuery:
    """Keeps one row per station with its latest reading, a new version with every batch."""

    def step(batch: DataFrame, before: DataFrame | None, put):
        latest = last_known(batch, fields)
        return latest if before is None else last_known(before.unionByName(latest), fields)

    return _stepwise(stream, step, path, checkpoint, poll)


def write_changes(
    scored: DataFrame, out: str, state: str, checkpoint: str, poll: str | None = None
) -> StreamingQuery:
    """Verdict changes per micro-batch with the batch operator, carried on by one verdict per station. A station
    with very many readings is split like any other."""

    def step(batch: DataFrame, before: DataFrame | None, put):
        put(changes_batch(batch, verdicts_before=before))
        return last_verdicts(batch, before)

    return _stepwise(scored, step, state, checkpoint, poll, out)


def write_published(
    alerts: DataFrame, out: str, state: str, checkpoint: str, poll: str | None = None,
    ttl: int = R.ALERT_TTL_SECONDS,
) -> StreamingQuery:
    """De-duplicated alerts per micro-batch, carried on by the publications of the last TTL."""

    def step(batch: DataFrame, before: DataFrame | None, put):
        published = put(dedup_batch(batch, ttl, before))
        now = batch.agg(F.max(seconds_since_1970(batch, "ts")).alias("now"))
        return still_held(published, before, now, ttl)

    return _stepwise(alerts, step, state, checkpoint, poll, out)


def write_documents(stream: DataFrame, kind: str, path: str, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Reads a stream of documents (``kind`` of ``documents.KINDS``): what can be read goes to ``path``/read, what cannot to
    ``path``/aside, and how many rows either got to ``path``/counts, a folder per micro-batch each. One broken document or
    entry does not stop the others. The batch is taken from its source once; the counts are observed while it is written."""
    read, aside = KINDS[kind]

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            counts = []
            for name, rows in (("read", read(batch)), ("aside", aside(batch))):
                seen = Observation()
                rows = rows.observe(seen, F.count(F.lit(1)).alias("n"))
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
                counts.append((name, seen.get["n"]))
            told = batch.sparkSession.createDataFrame(counts, "part string, n bigint")
            told.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return writer.trigger(**trigger).start()


def trim_log(messages: DataFrame, stream: str, per_station: bool = False) -> DataFrame:
    """The messages a bounded log keeps: the newest N of the whole stream, or of each station."""
    order = [F.col("ts").desc(), F.col("seq").desc()]
    return latest_rows(messages, KEPT_MESSAGES[stream], order, ["station_id"] if per_station else None)


def write_bounded_log(stream: DataFrame, name: str, path: str, checkpoint: str, poll: str | None = None) -> StreamingQuery:
    """Keeps the newest N messages (columns ts, seq, anything else) of a stream. A micro-batch is cut to N where it lies
    and meets the N that the log held before; each batch leaves a new version, so a restart carries on from the last one
    that was finished. ``bounded_log`` reads it."""

    def step(batch: DataFrame, before: DataFrame | None, put):
        newest = trim_log(batch, name)
        return newest if before is None else trim_log(before.unionByName(newest), name)

    return _stepwise(stream, step, path, checkpoint, poll)


def bounded_log(spark: SparkSession, path: str) -> DataFrame:
    """The messages that a log holds now: its newest version."""
    versions = spark.read.option("recursiveFileLookup", "false").parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == last).drop("version")


def stream_health(logs: dict[str, DataFrame]) -> DataFrame:
    """Entries and latest message time and text per log (ts, seq, payload)."""
    rows = None
    for name, log in logs.items():
        one = log.agg(
            F.lit(name).alias("stream"),
            F.count(F.lit(1)).alias("entries"),
            F.max("ts").alias("last_ts"),
            F.max_by("payload", F.struct("ts", "seq")).alias("last_payload"),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def latest_snapshots(
    snapshots: DataFrame, as_of: datetime, kind: str = "forecast", site: str = "station_id", at: str = "fetched_at"
) -> DataFrame:
    """All rows of the newest snapshot of every site at ``as_of``. An outdated one is still the last known good
    one and comes flagged ``stale``."""
    seen = snapshots.filter(F.col(at) <= wall_clock(as_of).cast(dict(snapshots.dtypes)[at]))
    newest = seen.groupBy(site).agg(F.max(at).alias(at))
    limit = as_of - timedelta(minutes=R.SNAPSHOT_TTL_MINUTES[kind])
    return seen.join(newest, [site, at]).withColumn(
        "stale", F.col(at) <= wall_clock(limit).cast(dict(snapshots.dtypes)[at])
    )
