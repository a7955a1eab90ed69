"""Verdict changes per station: a change is a previous non-empty verdict that differs from the new one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds_since_1970
from ..operators.hours import score_pour
from ..operators.ordered import BLOCK_ROWS, ROW, block_window, blocks, core_rows, number_rows
from ..session import ship_package

STATE = "last string"
MESSAGE_FACTORS = ["temperature", "humidity", "wind", "precipitation", "dewpoint", "data"]
READINGS = ["temp_f", "humidity_pct", "wind_mph", "wind_gust_mph", "dewpoint_f", "cloud_cover_pct", "precip_in"]


def score_readings(readings: DataFrame, prob: str | None = None) -> DataFrame:
    """Verdict of a current reading. Readings carry no rain probability, so they stay below green unless a
    probability column is named."""
    chance = F.col(prob).cast("double") if prob else F.lit(None).cast("double")
    return score_pour(readings.withColumn("precip_prob_pct", chance)).drop("precip_prob_pct")


def _changed(previous, new):
    return F.coalesce(previous.isNotNull() & ~previous.eqNullSafe(new), F.lit(False))


def changes_batch(
    scored: DataFrame, block_rows: int = BLOCK_ROWS, verdicts_before: DataFrame | None = None
) -> DataFrame:
    """``previous_score`` and ``score_changed`` for a finished table, in order of ``ts`` and ``seq``.

    ``verdicts_before`` (station_id, last_score) carries on from earlier rows. A station may report any number of
    times, so its rows are numbered by the hour.
    """
    hour = F.struct(F.col("ts").cast("date").alias("d"), F.hour("ts").alias("h"))
    numbered = number_rows(scored, ["station_id"], ["ts", "seq"], hour)
    w = block_window(["station_id"])
    previous = F.lag("pour_score").over(w)
    rows = blocks(numbered, before=1, block_rows=block_rows).withColumn("previous_score", previous)
    if verdicts_before is not None:
        # only a station's first row looks back; the row number in the key spreads the others
        start = verdicts_before.withColumn(ROW, F.lit(1).cast("bigint"))
        rows = rows.join(start, ["station_id", ROW], "left").withColumn(
            "previous_score", F.coalesce("previous_score", "last_score")
        ).drop("last_score")
    return core_rows(rows).withColumn("score_changed", _changed(F.col("previous_score"), F.col("pour_score")))


def last_verdicts(scored: DataFrame, verdicts_before: DataFrame | None = None) -> DataFrame:
    """(station_id, last_score) after all rows of ``scored``."""
    newest = scored.groupBy("station_id").agg(
        F.max_by(F.struct(F.col("pour_score").alias("last_score")), F.struct("ts", "seq")).alias("n")
    ).select("station_id", "n.last_score")
    if verdicts_before is None:
        return newest
    return newest.unionByName(verdicts_before.join(newest, "station_id", "left_anti"))


def _track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
    score = rows["pour_score"].astype(object)
    score = score.where(score.notna(), None)
    previous = [last, *score.iloc[:-1].tolist()]
    rows["previous_score"] = previous
    rows["score_changed"] = [p is not None and p != s for p, s in zip(previous, score)]
    state.update((score.iloc[-1],))
    yield rows


def changes_stream(scored: DataFrame) -> DataFrame:
    """The same in the state store: one verdict per station. A task holds the readings of one station that arrived
    since the last micro-batch, so bound those with ``maxFilesPerTrigger``; ``jobs.write_changes`` has no such
    limit."""
    ship_package(scored.sparkSession)
    columns = [f"{n} {t}" for n, t in scored.dtypes] + ["previous_score string", "score_changed boolean"]
    return scored.groupBy("station_id").applyInPandasWithState(
        _track, ", ".join(columns), STATE, "append", "NoTimeout"
    )


def weather_messages(changes: DataFrame) -> DataFrame:
    """Log rows: every value as text, empty where it is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return changes.select(
        F.col("station_id").alias("station"),
        text("station_name"),
        seconds_since_1970(changes, "ts").cast("string").alias("timestamp"),
        *[text(c) for c in READINGS],
        text("pour_score"),
        factor_json(F.col("pour_factors")).alias("pour_factors"),
        F.when(F.col("score_changed"), "1").otherwise("0").alias("score_changed"),
    )


def factor_json(factors: Column) -> Column:
    """Factors and their grades as a JSON object in the order in which they are graded; ``{}`` if there are none."""
    named = F.filter(F.lit(list(MESSAGE_FACTORS)), lambda n: F.coalesce(F.map_contains_key(factors, n), F.lit(False)))
    pairs = F.transform(named, lambda n: F.concat(F.lit('"'), n, F.lit('": "'), F.element_at(factors, n), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def live_updates(changes: DataFrame) -> DataFrame:
    """Typed payloads for subscribers."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    payload = F.struct(
        F.lit("weather_update").alias("type"),
        F.col("station_id").alias("station"),
        text("station_name"),
        *[text(c) for c in ("temp_f", "humidity_pct", "wind_mph", "dewpoint_f", "cloud_cover_pct")],
        text("pour_score"),
        "score_changed",
    )
    return changes.select("station_id", "ts", "seq", F.to_json(payload).alias("payload"))
