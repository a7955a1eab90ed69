"""Fixed-width station archives.

One line holds a station, month and element with 31 day slots of eight characters: value (5), measurement flag,
quality flag, source flag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R

HEAD, SLOT = 21, 8
# 269 characters with the line end, which the text reader strips; the last source flag may be cut.
MIN_LENGTH = 268


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` with ``source_seq``, which rises in file order: the byte position of the split plus a row count
    inside the task (a line is longer than one byte, so splits never overlap)."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spark.read.text(path).select(
        F.col("value").alias("line"), (F.col("_metadata.file_block_start") + in_task).alias("source_seq")
    )


def parse_lines(
    lines: DataFrame, first_year: int = R.FIRST_YEAR, elements: Sequence[str] = R.ELEMENTS
) -> DataFrame:
    """One row per station, day and element with a usable value.

    Year and element are filtered on the raw text before a line is opened up. Blank, -9999 and flagged values
    and days beyond the end of the month are dropped.
    """
    part = lambda start, size: F.substring("line", start + 1, size)
    heads = (
        lines.filter(F.length("line") >= MIN_LENGTH)
        .withColumn("year", F.trim(part(11, 4)).try_cast("int"))
        .withColumn("month", F.trim(part(15, 2)).try_cast("int"))
        .withColumn("element", F.trim(part(17, 4)))
        .filter(
            (F.col("year") >= first_year) & F.col("month").between(1, 12) & F.col("element").isin(*elements)
        )
        .withColumn("station_id", F.trim(part(0, 11)))
    )
    # cut the slots of a line once, by byte position (the archive is ASCII), and only as many as the month has days
    body = F.col("line").cast("binary")
    slots = F.array(*[F.substring(body, HEAD + 1 + SLOT * d, SLOT).cast("string") for d in range(31)])
    days = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    raw = F.trim(F.substring("slot", 1, 5))
    return (
        heads.select(
            "station_id", "year", "month", "element", "source_seq",
            F.posexplode(F.slice(slots, F.lit(1), days)).alias("place", "slot"),
        )
        .filter((F.trim(F.substring("slot", 7, 1)) == "") & (raw != "") & (raw != "-9999"))
        .select(
            "station_id",
            F.make_date("year", "month", F.col("place") + 1).alias("observation_date"),
            "element",
            raw.try_cast("int").alias("value"),
            "source_seq",
        )
        .filter(F.col("value").isNotNull())
    )


def observations(values: DataFrame, elements: Sequence[str] = R.ELEMENTS) -> DataFrame:
    """One row per station-day, elements as columns. A repeated value is settled by the later line.

    The lines of a month stand together in a file, so most of the pivot happens before the shuffle.
    """
    pick = lambda e: F.max_by(
        F.when(F.col("element") == e, F.col("value")), F.when(F.col("element") == e, F.col("source_seq"))
    ).alias(e)
    return values.groupBy("station_id", "observation_date").agg(*[pick(e) for e in elements])


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Station-month-elements that occur on more than one line."""
    key = F.substring("line", 1, HEAD).alias("line_key")
    return lines.filter(F.length("line") >= MIN_LENGTH).groupBy(key).count().filter("count > 1")
