"""Keyed writes to partitioned Parquet tables.

The row logic (``merge_rows`` and so on) is plain DataFrame code. Incoming rows are stored once, so that they are evaluated
once; the table itself is written once, straight from the partitions that it replaces: a dynamic overwrite writes beside them
and swaps folders when all tasks are done. Only partitions that receive rows are read and rewritten, and each is written as at
most FILES files, whatever the number of tasks.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..session import remove_path, scratch_dir

DAILY_KEY = ["station_id", "observation_date"]
SNAPSHOT_KEY = ["station_id", "forecast_hour", "fetched_at"]
#: Files of one partition in one write, at most, unless it has more than FILES x FILE_ROWS rows.
FILES = 8
#: Rows that a task sorts and writes as one file of a large partition, about.
FILE_ROWS = 500_000


# --- row logic -------------------------------------------------------------------------------


def latest_per_key(rows: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    """One row per key, the one with the highest ``sequence``; partial aggregation, so repeats of a key meet
    as one row per task. Of rows with equal sequence, or without one, the one with the greatest JSON text stays: the choice
    does not depend on the order in which rows arrive."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.dropDuplicates(keys)
    text = F.to_json(F.struct(*rest))
    order = F.struct(F.col(sequence), text) if sequence else text
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    ).select(*rows.columns)


def merge_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Insert or replace on ``keys``: every column of a matched row is replaced."""
    fresh = latest_per_key(incoming, keys, sequence)
    if sequence is not None and sequence not in existing.columns:
        fresh = fresh.drop(sequence)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def absent_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not in the table yet, once each."""
    return latest_per_key(incoming, keys, None).join(existing.select(*keys), keys, "left_anti")


def unexpired(snapshots: DataFrame, now: datetime, days: int = R.RETENTION_DAYS) -> DataFrame:
    """Snapshots not past retention; one without an expiry is kept."""
    past = F.col("expires_at") < F.lit((now - timedelta(days=days)).isoformat(sep=" ")).cast("timestamp")
    return snapshots.filter(~F.coalesce(past, F.lit(False)))


def latest_rows(rows: DataFrame, n: int, order: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows, of each key or of all. Tasks cut their share to ``n`` before any shuffle."""
    if not keys:
        return rows.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def last_known(messages: DataFrame, fields: list[str], key: str = "station_id", at: str = "ts") -> DataFrame:
    """One row per station with its latest message; of equal times the one with the highest ``seq``, where there is one."""
    order = F.struct(at, "seq") if "seq" in messages.columns else F.struct(at, *fields)
    pick = F.max_by(F.struct(*fields), order)
    return messages.groupBy(key).agg(pick.alias("_m"), F.max(at).alias(at)).select(
        key, at, *[F.col(f"_m.{f}").alias(f) for f in fields]
    )


# --- writers ---------------------------------------------------------------------------------


def _rows_of(rows: DataFrame, partition: str) -> dict:
    """Rows of each partition value. The values are few (years, days), unlike the rows behind them."""
    return {r[0]: r[1] for r in rows.groupBy(partition).agg(F.count(F.lit(1))).collect()}


def _added(*counts: dict) -> dict:
    return {value: sum(c.get(value, 0) for c in counts) for value in dict.fromkeys(v for c in counts for v in c)}


def _aside(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows as stored in a scratch folder, and that folder."""
    path = scratch_dir(rows.sparkSession, "incoming")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def _placed(rows: DataFrame, partition: str, keys: list[str], sizes: dict) -> DataFrame:
    """Every partition in at most FILES tasks, sorted by key: bounded files, and a large partition is still shared. One of
    which ``sizes`` says that it has more than FILES x FILE_ROWS rows is shared by more, so that none sorts more rows."""
    files = F.lit(FILES)
    for value, n in sizes.items():
        if n > FILES * FILE_ROWS:
            files = F.when(F.col(partition).eqNullSafe(F.lit(value)), -(-n // FILE_ROWS)).otherwise(files)
    share = F.pmod(F.xxhash64(*keys), files)
    return rows.repartition(F.col(partition), share).sortWithinPartitions(partition, *keys)


def _overwrite_partitions(rows: DataFrame, path: str, partition: str, keys: list[str], sizes: dict) -> None:
    writer = _placed(rows, partition, keys, sizes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(partition).parquet(path)


def in_ranges(rows: DataFrame, partition: str, keys: list[str]) -> DataFrame:
    """Range-partitioned by partition and key. Spark samples the rows for the bounds, so this goes before costly columns."""
    return rows.repartitionByRange(partition, *keys)


def create_table(rows: DataFrame, path: str, partition: str, keys: list[str]) -> None:
    """Even tasks, few files, tight min/max statistics."""
    in_ranges(rows, partition, keys).write.partitionBy(partition).parquet(path)


def upsert(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str, sequence: str | None = None
) -> None:
    """Insert or replace ``incoming`` in the table at ``path``. The key must determine the partition."""
    fresh = latest_per_key(incoming, keys, sequence)
    fresh, folder = _aside(fresh.drop(sequence) if sequence else fresh)
    existing = spark.read.schema(fresh.schema).parquet(path)
    new = _rows_of(fresh, partition)
    touched = existing.filter(F.col(partition).isin(list(new)))
    sizes = _added(new, _rows_of(touched, partition))
    _overwrite_partitions(merge_rows(touched, fresh, keys), path, partition, keys, sizes)
    remove_path(spark, folder)


def append_absent(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
    """Insert-or-ignore on keys that determine the partition; other partitions are not read. The files of the table are
    listed before the write, so what is appended is not read back."""
    fresh, folder = _aside(latest_per_key(incoming, keys, None))
    existing = spark.read.schema(fresh.schema).parquet(path)
    new = _rows_of(fresh, partition)
    near = existing.filter(F.col(partition).isin(list(new)))
    _placed(absent_rows(near, fresh, keys), partition, keys, new).write.mode("append").partitionBy(partition).parquet(path)
    remove_path(spark, folder)


def expire(
    spark: SparkSession, path: str, schema, now: datetime, partition: str = "fetched_date", keys: list[str] = SNAPSHOT_KEY
) -> None:
    """Deletes snapshots past retention. What the rows say decides: one aggregate per partition tells which partitions
    hold nothing to keep (removed as folders) and which hold both (rewritten); the others are left alone."""
    table = spark.read.schema(schema).parquet(path)
    staying = unexpired(table.select(partition, "expires_at"), now).groupBy(partition).agg(F.count("*").alias("kept"))
    found = table.groupBy(partition).agg(F.count("*").alias("rows")).join(staying, partition, "left").collect()
    mixed = [r[partition] for r in found if r["kept"] and r["kept"] < r["rows"]]
    gone = {str(r[partition]) for r in found if not r["kept"] and r[partition] is not None}
    if mixed:
        kept = {r[partition]: r["kept"] for r in found if r["kept"]}
        _overwrite_partitions(unexpired(table.filter(F.col(partition).isin(mixed)), now), path, partition, keys, kept)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name, _, value = status.getPath().getName().partition("=")
        if name == partition and value in gone:
            fs.delete(status.getPath(), True)


def snapshot_rows(scored: DataFrame, fetched_at: str = "fetched_at") -> DataFrame:
    """Scored forecast hours in the layout of the snapshot table."""
    c = F.col
    fetched = c(fetched_at).cast("timestamp")
    return scored.select(
        "station_id",
        c("time").alias("forecast_hour"),
        "temp_f", "humidity_pct", "wind_mph", "wind_gust_mph", "precip_prob_pct",
        c("precip_in").alias("precip_amount_in"),
        "dewpoint_f", "cloud_cover_pct", "pour_score",
        c("pour_factors").alias("score_factors"),
        fetched.alias("fetched_at"),
        (fetched + F.expr(f"interval {R.SNAPSHOT_LIFE_HOURS} hour")).alias("expires_at"),
        fetched.cast("date").alias("fetched_date"),
    )


# The columns each export carries, in table order.
EXPORTS = {
    "stations": ["station_id", "name", "covers", "state", "latitude", "longitude"],
    "daily_weather": [
        "station_id", "observation_date", "temp_max_f", "temp_min_f", "temp_mean_f", "precip_in", "snow_in",
        "snow_depth_in", "wind_avg_mph", "wind_max_mph", "pour_score", "sealer_score",
    ],
    "jobs": [
        "job_id", "start_date", "completion_date", "final_revenue", "month", "lead_name", "address", "job_type",
        "concrete_type", "lead_status", "square_footage", "concrete_company", "sealer_coats", "station_id",
    ],
}


def export_columns(table: DataFrame, name: str) -> DataFrame:
    """Projection for the warehouse: decimals as doubles, everything else as it is."""
    types = dict(table.dtypes)
    cast = lambda n: F.col(n).cast("double") if types[n].startswith("decimal") else F.col(n)
    return table.select(*[cast(n).alias(n) for n in EXPORTS[name]])


def export_table(table: DataFrame, name: str, path: str) -> bool:
    """Full refresh of one export; an empty table leaves the previous export in place."""
    if table.isEmpty():
        return False
    export_columns(table, name).write.mode("overwrite").parquet(path)
    return True


def materialise(df: DataFrame, name: str, layer: str, root: str | None = None) -> DataFrame:
    """Staging and intermediate layers become views, marts become Parquet tables with a view on them. Returns the frame
    behind the view: what reads a mart reads the stored rows."""
    if layer not in ("staging", "intermediate"):
        if root is None:
            raise ValueError("a mart needs a root folder")
        path = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        df = df.sparkSession.read.schema(df.schema).parquet(path)
    df.createOrReplaceTempView(name)
    return df
