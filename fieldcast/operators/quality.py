"""Data checks: one row per rule with the number of failures; a rule passes with 0.

Every table is scanned at most twice: once for all its row rules, once for the keys that it owns or refers to. The keys of
all tables form one tagged union, counted in one grouped aggregate: uniqueness and references are read off the same groups, so
there are no joins, and a frequent key is one row per task before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("green", "yellow", "red")


@dataclass(frozen=True)
class Rule:
    check: str  # not_null | accepted | range | not_after | unique | references
    table: str
    column: str  # comma-separated for unique keys
    arg: object = None


def standard_rules(as_of: date) -> list[Rule]:
    """The checks of the sources, staging views and marts."""
    day_after = as_of + timedelta(days=1)
    return [
        Rule("unique", "stations", "station_id"),
        Rule("not_null", "stations", "station_id"),
        Rule("not_null", "stations", "name"),
        Rule("unique", "daily", "station_id,observation_date"),
        Rule("not_null", "daily", "station_id"),
        Rule("not_null", "daily", "observation_date"),
        Rule("references", "daily", "station_id", ("stations", "station_id")),
        Rule("accepted", "daily", "pour_score", VERDICTS),
        Rule("accepted", "daily", "sealer_score", VERDICTS),
        Rule("range", "daily", "temp_max_f", (-40, 120)),
        Rule("range", "daily", "temp_min_f", (-40, 120)),
        Rule("not_after", "daily", "observation_date", day_after),
        Rule("unique", "jobs", "job_id"),
        Rule("not_null", "jobs", "job_id"),
        Rule("references", "jobs", "station_id", ("stations", "station_id")),
        Rule("references", "jobs", "station_id,start_date", ("daily", "station_id,observation_date")),
        Rule("unique", "coverage", "station_id"),
        Rule("not_null", "coverage", "station_id"),
        Rule("not_null", "coverage", "coverage_pct"),
        Rule("not_null", "seasons", "station_id"),
        Rule("not_null", "seasons", "year"),
        Rule("unique", "job_weather", "job_id"),
        Rule("not_null", "job_weather", "job_id"),
        Rule("accepted", "job_weather", "pour_day_score", VERDICTS),
        Rule("not_null", "year_over_year", "station_id"),
    ]


def _broken(rule: Rule) -> Column:
    c = F.col(rule.column)
    if rule.check == "not_null":
        return c.isNull()
    if rule.check == "accepted":
        return c.isNotNull() & ~c.isin(*rule.arg)
    if rule.check == "range":
        return c.isNotNull() & ~c.between(*rule.arg)
    if rule.check == "not_after":
        return c > F.lit(rule.arg)
    raise ValueError(rule.check)


def _row_rules(table: DataFrame, rules: list[Rule]) -> DataFrame:
    counts = table.agg(
        *[F.count_if(F.coalesce(_broken(r), F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    return _lines(counts, rules)


def _lines(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule from one row with a column r0, r1, ... per rule."""
    lines = [
        F.struct(
            F.lit(r.check).alias("check"), F.lit(r.table).alias("table"), F.lit(r.column).alias("column"),
            F.col(f"r{i}").alias("failures"),
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*lines)))


def _lookup(rule: Rule) -> tuple[str, str]:
    """The table and columns whose keys a key rule is about."""
    return (rule.table, rule.column) if rule.check == "unique" else rule.arg


def _tagged_keys(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """(lookup, key, user, n): one row per table row and role. ``user`` is NULL where the row owns the key, else the number
    of the rule by which it refers to it. Keys with a NULL part take no part; they are text in the type of the owner."""
    lookups = list(dict.fromkeys(_lookup(r) for r in rules))
    roles: dict[str, list] = {}
    for number, (table, columns) in enumerate(lookups):
        roles.setdefault(table, []).append((number, columns, None))
    for number, rule in enumerate(rules):
        if rule.check == "references":
            roles.setdefault(rule.table, []).append((lookups.index(_lookup(rule)), rule.column, number))
    parts = []
    for table, uses in roles.items():
        entries = []
        for number, columns, user in uses:
            owner, owned = lookups[number]
            types = [tables[owner].schema[c].dataType for c in owned.split(",")]
            key = F.array(*[F.col(c).cast(t).cast("string") for c, t in zip(columns.split(","), types)])
            entries.append(F.struct(F.lit(number).alias("lookup"), key.alias("key"), F.lit(user).cast("int").alias("user")))
        parts.append(
            tables[table].select(F.inline(F.array(*entries))).filter(~F.exists("key", lambda part: part.isNull()))
        )
    return reduce(DataFrame.unionByName, parts)


def _key_rules(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """A unique rule counts keys owned more than once, a reference rule the rows whose key nobody owns."""
    lookups = list(dict.fromkeys(_lookup(r) for r in rules))
    used = {i: F.count_if(F.col("user") == i).alias(f"u{i}") for i, r in enumerate(rules) if r.check == "references"}
    per_key = _tagged_keys(tables, rules).groupBy("lookup", "key").agg(F.count_if(F.col("user").isNull()).alias("owned"), *used.values())
    mine = lambda r: F.col("lookup") == lookups.index(_lookup(r))
    counts = per_key.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("owned") == 0, F.col(f"u{i}"))), F.lit(0)).alias(f"r{i}")
            if i in used else F.count_if(mine(r) & (F.col("owned") > 1)).alias(f"r{i}")
            for i, r in enumerate(rules)
        ]
    )
    return _lines(counts, rules)


def run_checks(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """check, table, column, failures. Rules on tables that are not given, or that refer to one, are left out."""
    keyed = [r for r in rules if r.check in ("unique", "references") and {r.table, _lookup(r)[0]} <= tables.keys()]
    parts = []
    for name in dict.fromkeys(r.table for r in rules if r.table in tables):
        mine = [r for r in rules if r.table == name and r.check not in ("unique", "references")]
        if mine:
            parts.append(_row_rules(tables[name], mine))
    if keyed:
        parts.append(_key_rules(tables, keyed))
    return reduce(DataFrame.unionByName, parts)


def unrealistic_temperatures(daily: DataFrame, low: float = -40, high: float = 120) -> DataFrame:
    off = lambda c: F.col(c).isNotNull() & ~F.col(c).between(low, high)
    return daily.filter(off("temp_max_f") | off("temp_min_f")).select(
        "station_id", "observation_date", "temp_max_f", "temp_min_f"
    )


def future_observations(daily: DataFrame, as_of: date) -> DataFrame:
    return daily.filter(F.col("observation_date") > F.lit(as_of + timedelta(days=1))).select(
        "station_id", "observation_date"
    )


def jobs_without_weather(jobs: DataFrame, daily: DataFrame) -> DataFrame:
    days = daily.select("station_id", F.col("observation_date").alias("start_date"))
    return jobs.join(days, ["station_id", "start_date"], "left_anti").select("job_id", "start_date", "station_id")
