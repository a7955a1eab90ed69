"""What a site is told at an instant: the newest good data of every feed, how old they are, and what follows from them.

A feed that was fetched within its time to live is fresh; one that was not is answered from its last good fetch and says
so; one that was never fetched leaves the question open, which is not the same as an empty answer. Every listed site gets
one row, silent ones too.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from .hours import SITE, best_overall, best_windows, by_day, score_pour, upcoming, wall_clock
from .reasons import day_summaries

UNAVAILABLE = "unavailable"
OK = "ok"
ALERTS_UNKNOWN, ALERTS_NONE, ALERTS_ACTIVE = "unknown", "none", "active"


def freshness(fetches: DataFrame, as_of: datetime, ttl_minutes: dict[str, int] = R.SNAPSHOT_TTL_MINUTES) -> DataFrame:
    """(station_id, <feed>_fetched_at, <feed>_stale for each feed) from ``fetches`` (station_id, feed, fetched_at), the log
    of fetches that succeeded. One aggregation finds the last fetch of all feeds; later ones than ``as_of`` do not count,
    and a feed that was never fetched has NULLs."""
    kind = dict(fetches.dtypes)["fetched_at"]
    seen = fetches.filter(F.col("fetched_at") <= wall_clock(as_of).cast(kind))
    last = seen.groupBy(SITE).agg(
        *[F.max(F.when(F.col("feed") == feed, F.col("fetched_at"))).alias(f"{feed}_fetched_at") for feed in ttl_minutes]
    )
    limit = lambda feed: wall_clock(as_of - timedelta(minutes=ttl_minutes[feed])).cast(kind)
    return last.withColumns({f"{feed}_stale": F.col(f"{feed}_fetched_at") <= limit(feed) for feed in ttl_minutes})


def newest_rows(rows: DataFrame, fresh: DataFrame, feed: str) -> DataFrame:
    """The rows of each site's newest fetch of a feed, from ``rows`` (station_id, fetched_at, ...). Older fetches are
    dropped by the join; a site's fetch without rows has none."""
    newest = fresh.select(SITE, F.col(f"{feed}_fetched_at").alias("fetched_at")).filter(F.col("fetched_at").isNotNull())
    return rows.join(newest, [SITE, "fetched_at"])


def with_freshness(decisions: DataFrame, sites: DataFrame, fresh: DataFrame, feeds: list[str]) -> DataFrame:
    """``decisions`` (a row per site) for every one of ``sites``, with status, stale and data_fetched_at over ``feeds``: the
    oldest of their last fetches, stale if any is. A site that lacks a feed is unavailable: stale and fetch time are NULL,
    and the decision keeps what it says about missing data."""
    there = [F.col(f"{feed}_fetched_at").isNotNull() for feed in feeds]
    whole, stale = there[0], F.col(f"{feeds[0]}_stale")
    for feed, is_there in zip(feeds[1:], there[1:], strict=True):
        whole, stale = whole & is_there, stale | F.col(f"{feed}_stale")
    stamps = [F.col(f"{feed}_fetched_at") for feed in feeds]
    oldest = F.least(*stamps) if len(stamps) > 1 else stamps[0]
    rows = sites.select(SITE).distinct().join(fresh, SITE, "left").join(decisions, SITE, "left")
    return rows.select(
        *decisions.columns,
        F.when(F.coalesce(whole, F.lit(False)), OK).otherwise(UNAVAILABLE).alias("status"),
        F.when(whole, stale).alias("stale"),
        F.when(whole, oldest).alias("data_fetched_at"),
    )


def alert_answers(alerts: DataFrame, fresh: DataFrame) -> DataFrame:
    """(station_id, alert_state, alerts) for every site of ``fresh``: the events of the newest alert fetch, the most severe
    first. A feed that was never read is ``unknown``; one that was read and held nothing is ``none``."""
    lines = newest_rows(alerts, fresh, "alerts").groupBy(SITE).agg(
        F.array_sort(F.collect_list(F.struct("severity_rank", "seq", F.coalesce("event", F.lit("")).alias("event")))).alias("_l")
    )
    state = F.when(F.col("alerts_fetched_at").isNull(), ALERTS_UNKNOWN).when(F.col("_l").isNull(), ALERTS_NONE).otherwise(ALERTS_ACTIVE)
    return fresh.join(lines, SITE, "left").select(SITE, state.alias("alert_state"), F.transform("_l", lambda x: x["event"]).alias("alerts"))


def forecast_answers(sites: DataFrame, fetches: DataFrame, forecast: DataFrame, alerts: DataFrame, as_of: datetime) -> DataFrame:
    """One answer per listed site: the days ahead with their verdicts, the best window with its date, freshness, and the
    state of the alerts.

    ``forecast`` holds the hours of all fetches (station_id, fetched_at, time, measures), ``alerts`` their relevant alerts
    (station_id, fetched_at, seq, event, severity_rank). A site without any forecast is unavailable and has no days."""
    fresh = freshness(fetches, as_of)
    hours = newest_rows(forecast, fresh, "forecast").drop("fetched_at")
    line = F.concat_ws(" ", F.col("date").cast("string"), F.coalesce("score", F.lit("no data")), F.coalesce("best_window", F.lit("-")), F.when(F.col("outlook"), "outlook"))
    days = day_summaries(hours, as_of).groupBy(SITE).agg(F.array_sort(F.collect_list(line)).alias("days"))  # at most a week
    ahead = upcoming(hours, as_of)
    best = best_overall(best_windows(by_day(score_pour(ahead)))).select(
        SITE, F.col("date").alias("best_date"), "best_window", F.col("window_hours").alias("best_hours")
    )
    told = with_freshness(days.join(best, SITE, "left"), sites, fresh, ["forecast"])
    named = sites.select(SITE, "name", "covers")
    unknown = F.coalesce("alert_state", F.lit(ALERTS_UNKNOWN)).alias("alert_state")
    return named.join(told, SITE).join(alert_answers(alerts, fresh), SITE, "left").select(
        SITE, "name", "covers", "status", "stale", "data_fetched_at", "days", "best_date", "best_window", "best_hours", unknown, "alerts"
    )

