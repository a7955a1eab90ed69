"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_dir

#: Arrow batches sent to Python workers stay below this size whatever the length of the texts.
BATCH_BYTES = 32 * 1024 * 1024
FOLDS = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch: ten thousand rows of very long texts must not meet in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared scratch folder and read again: cuts the lineage, survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    remove_path(spark, path)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo five: 0 is held out from learning. NULL for a NULL key."""
    return F.crc32(key.cast("string")) % FOLDS


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones on every run: those with the smallest hash of the key."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)
