"""Clock arithmetic on wall-clock and absolute times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seconds_since_1970(df: DataFrame, name: str) -> Column:
    """Whole seconds of a time column. Wall-clock times count on their own clock, whatever the session zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_timestamp(name)
