"""Declared tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S

DECLARED = {"stations": S.STATIONS, "daily_weather": S.DAILY, "jobs": S.JOBS, "weather_forecasts": S.SNAPSHOTS}
DRIFT = "table string, column string, declared string, found string, difference string"


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _differences(spark: SparkSession, root: str, name: str) -> list[tuple]:
    """What the files' own schema has against the declared one; only a footer is read."""
    declared = {f.name: f.dataType.simpleString() for f in DECLARED[name]}
    found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(_path(root, name)).schema}
    out = []
    for column in dict.fromkeys([*declared, *found]):
        want, have = declared.get(column), found.get(column)
        if want != have:
            out.append((name, column, want, have, "missing" if have is None else "extra" if want is None else "type"))
    return out


def schema_drift(spark: SparkSession, root: str, names: Iterable[str] = tuple(DECLARED)) -> DataFrame:
    """table, column, declared, found, difference: ``missing`` and ``extra`` columns, and those of another ``type``. Partition
    columns count as extra; a table as declared has no row."""
    return spark.createDataFrame([row for name in names for row in _differences(spark, root, name)], DRIFT)


def declared_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table folder read with its declared schema; partition columns (``obs_year``) come on top. A missing column is NULL,
    an extra one is left out, and a column of another type is refused before anything is read."""
    wrong = [f"{column} is {have}, not {want}" for _, column, want, have, kind in _differences(spark, root, name) if kind == "type"]
    if wrong:
        raise ValueError(f"table {name}: {', '.join(wrong)}")
    return spark.read.schema(DECLARED[name]).parquet(_path(root, name))
