"""Ordered-frame helpers that never put one key's whole history into one task.

A plain ``Window.partitionBy(station)`` sends a station with a third of all rows to a single task. Here a
history is numbered chunk by chunk, cut into blocks of consecutive rows, and every block carries the few
neighbouring rows its frames need. Frames over a block then equal frames over the whole history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
ROW, CHUNK, BLOCK, CORE = "_row", "_chunk", "_block", "_core"


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str = ROW) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)``.

    ``chunk`` must rise with the order (a year, a day): rows of a smaller chunk come first. Per-chunk counts
    are small (one row per key and chunk); their running sum is the offset of each chunk, and only rows of one
    chunk meet in a task. Keys and chunk must not be NULL; saying so once here leaves both branches with the same
    filters, so Spark can reuse one shuffle of ``df`` for them.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, CHUNK]])
    chunked = df.withColumn(CHUNK, chunk).filter(whole)
    counts = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (
        chunked.join(offsets, [*keys, CHUNK])
        .withColumn(out, F.col("_before") + F.row_number().over(local))
        .drop("_before", CHUNK)
    )


def blocks(df: DataFrame, before: int, after: int = 0, block_rows: int = BLOCK_ROWS, row: str = ROW) -> DataFrame:
    """Cuts numbered rows into blocks and copies ``before``/``after`` rows across each block edge.

    Adds ``_block`` and ``_core``; keep only ``_core`` rows once the frames are evaluated.
    """
    if block_rows < max(before, after, 1):
        raise ValueError("block_rows must not be smaller than the frame")
    own = F.floor((F.col(row) - 1) / F.lit(block_rows)).cast("bigint")
    place = F.pmod(F.col(row) - 1, F.lit(block_rows))
    targets = F.array_compact(
        F.array(
            own,
            F.when(place >= block_rows - before, own + 1) if before else F.lit(None).cast("bigint"),
            F.when((place < after) & (own > 0), own - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return df.withColumn("_own", own).withColumn(BLOCK, F.explode(targets)).withColumn(
        CORE, F.col(BLOCK) == F.col("_own")
    ).drop("_own")


def block_window(keys: list[str], row: str = ROW) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(row)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(CORE, BLOCK, ROW)
