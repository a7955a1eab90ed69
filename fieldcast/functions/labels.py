"""Clock, window, day and verdict labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _twelve(hour: Column) -> Column:
    h = F.pmod(hour, F.lit(12))
    return F.when(h == 0, 12).otherwise(h).cast("string")


def clock(hour: Column) -> Column:
    """13 -> 1pm, 0 -> 12am."""
    return F.concat(_twelve(hour), F.when(hour < 12, "am").otherwise("pm"))


def clock_short(hour: Column) -> Column:
    """13 -> 1p, 0 -> 12a."""
    return F.concat(_twelve(hour), F.when(hour < 12, "a").otherwise("p"))


def window_text(start: Column, length: Column) -> Column:
    """07:00-12:00."""
    pad = lambda h: F.lpad(h.cast("string"), 2, "0")
    return F.concat(pad(start), F.lit(":00-"), pad(start + length), F.lit(":00"))


def window_label(window: Column) -> Column:
    """07:00-12:00 -> 7a-12p; anything that is not two clock times passes through."""
    start = F.regexp_extract(window, r"^(\d{2})[^-]*-\d{2}[^-]*$", 1)
    end = F.regexp_extract(window, r"^\d{2}[^-]*-(\d{2})[^-]*$", 1)
    short = F.concat(clock_short(start.try_cast("int")), F.lit("-"), clock_short(end.try_cast("int")))
    return F.when(window.isNull() | (window == ""), None).when(start == "", window).otherwise(short)


def day_label(day: Column, today: Column) -> Column:
    """Today / Tomorrow / Yesterday, otherwise the short weekday name."""
    away = F.datediff(day, today)
    return (
        F.when(away == 0, "Today")
        .when(away == 1, "Tomorrow")
        .when(away == -1, "Yesterday")
        .otherwise(F.date_format(day, "E"))
    )


def strict_date(text: Column) -> Column:
    """The date for YYYY-MM-DD text, NULL for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _clock_text(hour: str) -> str:
    return f"concat(case when pmod({hour}, 12) = 0 then 12 else pmod({hour}, 12) end, if({hour} < 12, 'am', 'pm'))"


def span_phrase(hours: str, start: int, end: int) -> Column:
    """A set of working hours (an array column) in words."""
    first, last, n = f"array_min({hours})", f"array_max({hours})", f"size({hours})"
    ends = f"concat({_clock_text(first)}, '-', {_clock_text(f'{last} + 1')})"
    return F.expr(
        f"""case
          when {n} <= 0 then ''
          when {n} = {end - start} then 'all day'
          when {last} - {first} + 1 = {n} and {first} = {start} then concat('before ', {_clock_text(f'{last} + 1')})
          when {last} - {first} + 1 = {n} and {last} = {end - 1} then concat('after ', {_clock_text(first)})
          when {last} - {first} + 1 = {n} then {ends}
          when {n} <= 3 then array_join(transform(array_sort({hours}), h -> {_clock_text('h')}), ', ')
          else concat({ends}, ', on and off') end"""
    )


def _verdict_text(verdict: Column, green: str, yellow: str, red: str, none: str) -> Column:
    return F.when(verdict == "green", green).when(verdict == "yellow", yellow).when(verdict == "red", red).otherwise(none)


def sealer_verdict_text(verdict: Column) -> Column:
    return _verdict_text(verdict, "SAFE TO SEAL", "USE CAUTION", "DO NOT SEAL", "NO DATA — DO NOT SEAL")


def cure_verdict_text(verdict: Column) -> Column:
    return _verdict_text(
        verdict, "SAFE TO POUR & CURE", "POUR WITH CAUTION", "DO NOT POUR", "NO DATA — DO NOT POUR"
    )
