"""Alert de-duplication: an alert id is published again only a full TTL after its last publication.

Irrelevant alerts never mark an id as seen, so relevance is filtered first. A missing id counts as the id ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.times import seconds_since_1970
from ..session import ship_package, stored
from ..sources.documents import relevant_alerts

STATE = "last_published bigint"
MAP = "alert_id string, g bigint, until array<bigint>, leaves array<bigint>"
#: TTLs in a stretch, and stretches in the next larger one.
FAN = 32
NEVER = -(1 << 62)
FRAME_VALUES = 20_000


def _publications(seconds: np.ndarray, last: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Positions to publish among ascending arrival seconds; jumps from one publication to the next."""
    picked: list[int] = []
    at = 0 if last is None else int(np.searchsorted(seconds, last + ttl))
    while at < len(seconds):
        picked.append(at)
        last = int(seconds[at])
        at = int(np.searchsorted(seconds, last + ttl))
    return picked, last


def relevant_arrivals(alerts: DataFrame, description_length: int = 500) -> DataFrame:
    """Relevant alerts with ``arrived`` in whole seconds, the resolution of the TTL."""
    return relevant_alerts(alerts, description_length).drop("severity_rank").withColumns(
        {
            "alert_id": F.coalesce(F.col("alert_id"), F.lit("")),
            "arrived": seconds_since_1970(alerts, "ts"),
        }
    )


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of every run of rows with equal keys, across the borders of batches."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        columns = {c: batch[c].to_numpy() for c in batch}
        if not len(batch):
            continue
        turns = np.zeros(len(batch) - 1, bool)
        for k in keys:
            turns |= columns[k][1:] != columns[k][:-1]
        edges = [0, *(np.flatnonzero(turns) + 1), len(batch)]
        for lo, hi in zip(edges, edges[1:]):
            part = {c: v[lo:hi] for c, v in columns.items()}
            if held and any(held[-1][k][-1] != part[k][0] for k in keys):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def _gathered(fold):
    """Makes frames of what ``fold`` yields for single groups (columns by name), many groups to a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        size = 0
        frame = lambda: pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "x" else v for c, v in held.items()})
        for part in fold(batches):
            for column, values in part.items():
                held.setdefault(column, []).extend(values)
            size += len(part["until"][0]) if "until" in part else len(part["alert_id"])
            if size >= FRAME_VALUES:
                yield frame()
                held, size = {}, 0
        if held:
            yield frame()

    return run


def _map_of(seconds: np.ndarray, first_end: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch does to the TTL, as (until, leaves): whoever may publish from second x on enters at the first
    ``until`` that is not before x and leaves with ``leaves`` as last publication; beyond the last one nothing is
    published. Only entries up to ``first_end`` and the next one can be reached from outside."""
    ahead = np.searchsorted(seconds, seconds + ttl)
    last = np.where(ahead < len(seconds), ahead, np.arange(len(seconds)))
    while True:  # pointers double until each one is at its last publication here
        further = last[last]
        if (further == last).all():
            break
        last = further
    n = min(len(seconds), int(np.searchsorted(seconds, first_end)) + 1)
    return _merged_steps(seconds[:n], seconds[last[:n]])


def _merged_steps(until: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.append(leaves[1:] != leaves[:-1], True)
    return until[keep], leaves[keep]


def _through(until: np.ndarray, leaves: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether something is published, the last publication) for each x."""
    at = np.searchsorted(until, x)
    hit = at < len(until)
    return hit, leaves[np.minimum(at, len(until) - 1)]


def _composed(maps: list[tuple[np.ndarray, np.ndarray]], ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of several stretches in a row."""
    until, leaves = maps[0]
    for next_until, next_leaves in maps[1:]:
        hit, after = _through(next_until, next_leaves, leaves + ttl)
        until = np.append(until, next_until[0])  # for whoever finds nothing in the stretches before
        leaves = np.append(np.where(hit, after, leaves), next_leaves[0])
        until, leaves = _merged_steps(until, leaves)
    return until, leaves


def _spread(rows: DataFrame, group: str, order: str) -> DataFrame:
    return rows.repartition("alert_id", group).sortWithinPartitions("alert_id", group, order)


def publications(
    keys: DataFrame, ttl: int = R.ALERT_TTL_SECONDS, published_before: DataFrame | None = None, fan: int = FAN
) -> DataFrame:
    """(alert_id, arrived) of the arrivals that are published, from distinct ``keys`` (alert_id, arrived). What arrives
    within a TTL of ``published_before`` (alert_id, last_published), or before it, is left out first.

    An id's arrivals are cut into stretches of ``fan`` TTLs. What a stretch does to the last publication is a step
    function with at most one step per second of a TTL; the functions of ``fan`` stretches are composed into one, level
    by level, and the entry of every stretch is then read downwards. A task holds one stretch, or the functions of
    ``fan`` stretches, however often an id arrives and however long it lives. The number of levels grows with the
    logarithm of the table's span; a span of one stretch needs none."""
    spark = keys.sparkSession
    ship_package(spark)
    keys = keys.select("alert_id", "arrived")
    if published_before is not None:
        free = F.coalesce(F.col("arrived") >= F.col("last_published") + ttl, F.lit(True))
        keys = keys.join(published_before, "alert_id", "left").filter(free).select("alert_id", "arrived")
    keys = stored(keys, "arrivals")
    span = keys.agg(F.min("arrived").alias("first"), F.max("arrived").alias("last")).first()
    if span["first"] is None:
        return keys
    origin, width = span["first"], ttl * fan
    levels = 1
    while span["last"] - origin >= ttl * fan**levels:
        levels += 1
    group = F.floor((F.col("arrived") - origin) / F.lit(width)).cast("bigint")
    arrivals = _spread(keys.withColumn("g", group), "g", "arrived")
    maps = []
    for level in range(1, levels):
        if level == 1:
            def lift(batches, origin=origin):
                for one in _groups(batches, ["alert_id", "g"]):
                    start = origin + int(one["g"][0]) * width
                    until, leaves = _map_of(one["arrived"].astype(np.int64), start + ttl, ttl)
                    yield {"alert_id": one["alert_id"][:1], "g": one["g"][:1], "until": [until], "leaves": [leaves]}

            lifted = arrivals.mapInPandas(_gathered(lift), MAP)
        else:
            def lift(batches):
                for one in _groups(batches, ["alert_id", "parent"]):
                    until, leaves = _composed(list(zip(one["until"], one["leaves"])), ttl)
                    yield {"alert_id": one["alert_id"][:1], "g": one["parent"][:1], "until": [until], "leaves": [leaves]}

            lifted = _spread(maps[-1].withColumn("parent", F.floor(F.col("g") / fan)), "parent", "g").mapInPandas(_gathered(lift), MAP)
        maps.append(stored(lifted, "maps"))
    # downwards: from which second on each stretch may publish; an id's first arrival always may
    entry = None

    def enter(batches):
        for one in _groups(batches, ["alert_id", "parent"]):
            x, entries = one["x"][0], []
            for until, leaves in zip(one["until"], one["leaves"]):
                entries.append(x)
                hit, last = _through(until, leaves, np.array([NEVER if pd.isna(x) else x]))
                x = int(last[0]) + ttl if hit[0] else x
            yield {"alert_id": one["alert_id"], "g": one["g"], "x": [None if pd.isna(e) else int(e) for e in entries]}

    for level in reversed(maps):
        if entry is None:  # one group of stretches holds all of an id
            rows = level.withColumns({"parent": F.lit(0).cast("bigint"), "x": F.lit(None).cast("bigint")})
        else:
            rows = level.withColumn("parent", F.floor(F.col("g") / fan)).join(entry.withColumnRenamed("g", "parent"), ["alert_id", "parent"])
        entry = _spread(rows, "parent", "g").mapInPandas(_gathered(enter), "alert_id string, g bigint, x bigint")

    def walk(batches):
        for one in _groups(batches, ["alert_id", "g"]):
            x = one["x"][0]
            seconds = one["arrived"].astype(np.int64)
            picked, _ = _publications(seconds, None if pd.isna(x) else int(x) - ttl, ttl)
            yield {"alert_id": one["alert_id"][picked], "arrived": seconds[picked]}

    entered = keys.withColumn("g", group)
    if entry is None:
        entered = entered.withColumn("x", F.lit(None).cast("bigint"))
    else:
        entered = entered.join(entry, ["alert_id", "g"])
    return _spread(entered, "g", "arrived").mapInPandas(_gathered(walk), "alert_id string, arrived bigint")


def dedup_batch(
    alerts: DataFrame, ttl: int = R.ALERT_TTL_SECONDS, published_before: DataFrame | None = None, fan: int = FAN
) -> DataFrame:
    """Published alerts of a finished table; among arrivals of one second the lowest ``seq`` speaks.

    ``published_before`` (alert_id, last_published) carries earlier publications on. Only ids and seconds take part in
    the decision; the alerts themselves are joined to the seconds that won."""
    arrivals = relevant_arrivals(alerts)
    keys = arrivals.select("alert_id", "arrived").distinct()
    won = publications(keys, ttl, published_before, fan)
    rest = [c for c in arrivals.columns if c not in ("alert_id", "arrived")]
    spoken = arrivals.join(won, ["alert_id", "arrived"]).groupBy("alert_id", "arrived")
    return spoken.agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(
        "alert_id", "arrived", *[F.col(f"r.{c}").alias(c) for c in rest]
    )


def still_held(
    published: DataFrame, before: DataFrame | None, now: DataFrame, ttl: int = R.ALERT_TTL_SECONDS
) -> DataFrame:
    """(alert_id, last_published) of the ids that are still inside their TTL at the latest arrival ``now`` (one
    row, column ``now``): what has to be remembered, at most one TTL of publications."""
    latest = published.select("alert_id", F.col("arrived").alias("last_published"))
    both = latest if before is None else latest.unionByName(before)
    last = both.groupBy("alert_id").agg(F.max("last_published").alias("last_published"))
    return last.filter(F.coalesce(F.col("last_published") + ttl > now.scalar(), F.lit(True)))


def _publish(ttl: int):
    def track(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = None
        for batch in batches:  # one row per second is enough, however often an id repeats
            rows = batch if rows is None else pd.concat([rows, batch], ignore_index=True)
            rows = rows.sort_values(["arrived", "seq"], kind="stable").drop_duplicates("arrived")
        picked, last = _publications(rows["arrived"].to_numpy(np.int64), last, ttl)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[picked]

    return track


def dedup_stream(alerts: DataFrame, ttl: int = R.ALERT_TTL_SECONDS, lateness: str = "24 hours") -> DataFrame:
    """Exact de-duplication in the state store: per id the second of its last publication, forgotten once the
    watermark has passed its TTL. For few ids and low latency; ``jobs.write_published`` suits many ids."""
    ship_package(alerts.sparkSession)
    stamped = relevant_arrivals(alerts).withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals = stamped.withWatermark("ts", lateness)
    schema = ", ".join(f"{n} {t}" for n, t in arrivals.dtypes)
    return arrivals.groupBy("alert_id").applyInPandasWithState(
        _publish(ttl), schema, STATE, "append", "EventTimeTimeout"
    )


def dedup_stream_watermark(alerts: DataFrame, hours: int = R.ALERT_TTL_SECONDS // 3600) -> DataFrame:
    """Approximate and fully native: state expires by event time, repeats inside one micro-batch collapse to
    one row whatever their distance."""
    stamped = relevant_arrivals(alerts).withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["alert_id"])


def live_alerts(alerts: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    payload = F.struct(
        F.lit("nws_alert").alias("type"),
        *[text(c) for c in ("event", "headline", "severity", "areas", "onset", "expires")],
    )
    return alerts.select("alert_id", "ts", "seq", F.to_json(payload).alias("payload"))
