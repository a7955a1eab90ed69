"""Day verdicts, windows, reasons, sealer and cure decisions on small hand-made days."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import cure, hours, reasons, sealer

DAY0 = datetime(2024, 5, 6)
FIELDS = ["temp_f", "humidity_pct", "wind_mph", "precip_prob_pct", "dewpoint_f", "precip_in", "wind_gust_mph", "cloud_cover_pct"]
SCHEMA = "station_id string, time timestamp_ntz, hour int, " + ", ".join(f"{f} double" for f in FIELDS)
GOOD = dict(temp_f=72.0, humidity_pct=50.0, wind_mph=5.0, precip_prob_pct=5.0, precip_in=0.0)


def hour_rows(site, per_hour, start=DAY0):
    """per_hour: {hours since start: overrides, or None for an hour without any reading}"""
    out = []
    for h, change in per_hour.items():
        t = start + timedelta(hours=h)
        values = {f: None for f in FIELDS}
        if change is not None:
            values |= GOOD | {k: (None if v is None else float(v)) for k, v in change.items()}
        out.append((site, t, t.hour, *[values[f] for f in FIELDS]))
    return out


def scored_days(spark, days):
    """days: {site: {hour: verdict}} straight as scored hours"""
    rows = [(s, DAY0 + timedelta(hours=h), h, v) for s, d in days.items() for h, v in d.items()]
    df = spark.createDataFrame(rows, "station_id string, time timestamp_ntz, hour int, pour_score string")
    return hours.by_day(df.withColumn("temp_f", F.lit(1.0)))


def test_day_verdicts(spark):
    g = lambda a, b: {h: "green" for h in range(a, b)}
    days = {
        "evening": {h: "red" for h in range(18, 24)},
        "unscored": {h: None for h in range(7, 18)},
        "green": g(7, 18),
        "gap": g(7, 16) | {16: None},
        "red": g(7, 16) | {16: "red"},
        "five pm": g(7, 17) | {17: "red"},
        "night": g(7, 18) | {3: "red", 22: "red"},
        "red and gap": g(7, 15) | {15: "red", 16: None},
    }
    want = dict(evening=None, unscored=None, green="green", gap="yellow", red="red", night="green",
                **{"five pm": "green", "red and gap": "red"})
    got = {r.station_id: r.score for r in hours.day_verdicts(scored_days(spark, days)).collect()}
    assert got == want


def loop_window(entries, start=7, end=17):
    """The longest run, by a plain loop over the list."""
    for limit in (("green",), ("green", "yellow")):
        best = None
        run = []
        for h, v in [*entries, (99, None)]:
            if start <= h < end and v in limit:
                run.append(h)
                if best is None or len(run) > best[1]:
                    best = (run[0], len(run))
            else:
                run = []
        if best:
            return f"{best[0]:02d}:00-{best[0] + best[1]:02d}:00"
    return None


def test_best_windows(spark):
    import random

    rnd = random.Random(3)
    days = {
        "full": {h: "green" for h in range(7, 18)},
        "middle": {h: "green" if h in (8, 9, 10) else "red" for h in range(6, 20)},
        "yellow": {h: "yellow" if h in (7, 8, 9) else "red" for h in range(6, 20)},
        "red": {h: "red" for h in range(6, 20)},
        "early": {h: "green" if h < 7 else "red" for h in range(3, 18)},
        "hole": {7: "green", 8: "green", 12: "green", 13: "red"},  # rows count, not clock distance
    }
    for i in range(60):
        present = sorted(rnd.sample(range(24), rnd.randint(3, 24)))
        days[f"r{i}"] = {h: rnd.choice(["green", "green", "yellow", "red", None]) for h in present}
    got = {r.station_id: r.best_window for r in hours.best_windows(scored_days(spark, days)).collect()}
    for name, d in days.items():
        assert got.get(name) == loop_window(list(d.items())), name
    assert got["full"] == "07:00-17:00" and got["hole"] == "07:00-10:00"


@pytest.fixture(scope="module")
def told(spark):
    fine = {h: {} for h in range(7, 17)}
    sites = {
        "clear": fine,
        "rain": fine | {h: dict(temp_f=70, humidity_pct=60, wind_mph=8, precip_prob_pct=70) for h in range(12, 17)},
        "mixed": fine | {h: dict(temp_f=42) for h in (7, 8, 9)} | {h: dict(wind_mph=24) for h in (14, 15, 16)},
        "cold": {h: dict(temp_f=35) for h in range(7, 17)},
        "hot": {h: dict(temp_f=98, humidity_pct=40) for h in range(7, 17)},
        "evening": {h: dict(precip_prob_pct=90) for h in range(18, 24)},
        "blank": {h: None for h in range(7, 17)},
        "one gap": fine | {10: None},
        "half gap": fine | {10: dict(humidity_pct=None)},
        "late rain": fine | {17: dict(precip_prob_pct=95)},
        "dry air": {h: dict(humidity_pct=12) for h in range(7, 17)},
        "dew": fine | {9: dict(dewpoint_f=68), 13: dict(dewpoint_f=64)},
    }
    rows = [r for s, d in sites.items() for r in hour_rows(s, d)]
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.station_id: r for r in reasons.day_summaries(df, DAY0).collect()}


def test_day_reasons(told):
    assert told["clear"].reasons == [] and told["clear"].score == "green"
    assert told["rain"].reasons == ["Rain likely — 70% chance after 12pm"]
    assert told["mixed"].reasons == ["High wind — 24mph after 2pm", "Cold — 42°F before 10am"]
    assert told["cold"].reasons == ["Too cold — 35°F all day"]
    assert told["hot"].reasons == ["Too hot — 98°F all day"]
    assert told["evening"].reasons == [reasons.NO_DATA] and told["evening"].score is None
    assert told["blank"].reasons == [reasons.NO_DATA]
    assert told["one gap"].reasons == ["Missing data for 1 working hour(s)"]
    assert told["half gap"].reasons == ["Missing forecast data 10am-11am"]
    assert told["late rain"].reasons == []
    assert told["dry air"].reasons == ["Very dry air — 12% all day (surface may crust)"]
    assert told["dew"].reasons == ["Dew point within 4°F of air temp 9am-10am — slow drying"]


def test_summary_columns(told):
    r = told["mixed"]
    assert (r.label, r.temp_high_f, r.temp_low_f, r.best_window, r.outlook) == ("Today", 72.0, 42.0, "10:00-14:00", False)
    assert r.best_window_label == "10a-2p"


def test_outlook_starts_after_48_rows(spark):
    rows = hour_rows("a", {h: {} for h in range(72)})
    got = {r.date.day: r.outlook for r in reasons.day_summaries(spark.createDataFrame(rows, SCHEMA), DAY0 + timedelta(hours=1)).collect()}
    assert got == {6: False, 7: False, 8: False}
    got = {r.date.day: r.outlook for r in reasons.day_summaries(spark.createDataFrame(rows, SCHEMA), DAY0).collect()}
    assert got == {6: False, 7: False, 8: True}


def test_sealer_inputs_and_reasons(spark):
    now = DAY0 + timedelta(hours=24, minutes=30)
    past = {h: {} for h in range(25)}
    ahead = {h: {} for h in range(24, 60)}

    def check(history, forecast):
        h = spark.createDataFrame([r for s, d in history.items() for r in hour_rows(s, d)], SCHEMA)
        f = spark.createDataFrame([r for s, d in forecast.items() for r in hour_rows(s, d)], SCHEMA)
        return {r.station_id: r for r in sealer.sealer_check(h, f, now).collect()}

    sparse = {h: {} for h in range(18, 25)}
    history = {
        "dry": past,
        "sparse": sparse,
        "sparse wet": sparse | {20: dict(precip_in=0.42)},
        "two unknown": past | {3: dict(precip_in=None), 4: dict(precip_in=None)},
        "three unknown": past | {3: dict(precip_in=None), 4: dict(precip_in=None), 5: dict(precip_in=None)},
        "tenths": past | {h: dict(precip_in=0.01) for h in range(1, 11)},
        "night": past,
        "few probs": past,
        "no forecast": past,
    }
    forecast = {s: ahead for s in history if s != "no forecast"}
    forecast["night"] = ahead | {30: dict(temp_f=34)}
    forecast["few probs"] = {h: dict(precip_prob_pct=45 if h == 26 else (5 if h < 30 else None)) for h in range(24, 60)}
    got = check(history, forecast)
    assert got["dry"].rain_last_24h == 0 and got["dry"].sealer_score == "green" and got["dry"].reasons == []
    assert got["dry"].verdict == "SAFE TO SEAL" and got["dry"].details[0] == "No rain in last 24h"
    assert got["sparse"].rain_last_24h is None and got["sparse"].sealer_score == "yellow"
    assert got["sparse"].reasons == ["Some readings unavailable — verdict capped at caution"]
    assert got["sparse wet"].reasons[0] == '0.42" rain in last 24h — slab needs to dry'
    assert got["two unknown"].rain_last_24h == 0 and got["three unknown"].rain_last_24h is None
    assert got["tenths"].rain_last_24h == 0.1 and got["tenths"].sealer_score == "red"
    assert got["night"].low_next_12h == 34 and "Too cold overnight — dropping to 34°F while it cures" in got["night"].reasons
    assert got["few probs"].prob_next_24h == 45
    assert got["no forecast"].prob_next_24h is None and got["no forecast"].sealer_score == "yellow"


def test_cure_windows(spark):
    two = lambda **k: {h: k for h in range(48)}
    sites = {
        "good": two(),
        "blank": {h: None for h in range(48)},
        "no wind": two(wind_mph=None),
        "no temp": two(temp_f=None),
        "freeze": two(temp_f=35),
        "cool": two(temp_f=44.5),
        "rain": two() | {h: dict(precip_prob_pct=80) for h in range(24)},
        "wet": two() | {h: dict(precip_in=0.05) for h in range(2)},
        "late rain": two() | {30: dict(precip_prob_pct=40)},
        "gusts": two(wind_mph=10, wind_gust_mph=40),
        "breeze": two(wind_mph=10, wind_gust_mph=28),
        "hot": two(temp_f=96),
        "no rain data": two(precip_prob_pct=None, precip_in=None),
    }
    rows = [r for s, d in sites.items() for r in hour_rows(s, d)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.station_id: r for r in cure.cure_check(df, DAY0).collect()}
    assert got["good"].score == "green" and "data" not in got["good"].factors and got["good"].issues == []
    assert got["blank"].score is None and got["blank"].factors == {} and len(got["blank"].issues) == 1
    assert got["no wind"].score == "yellow" and got["no wind"].factors["data"] == "yellow"
    assert got["no wind"].issues == ["Missing forecast data (wind) — treat with caution"]
    assert "freeze_risk" not in got["no temp"].factors and got["no temp"].score == "yellow"
    assert got["freeze"].score == "red" and got["freeze"].factors["freeze_risk"] == "red"
    assert got["cool"].issues == ["Temp drops to 44°F — consider blankets/enclosures"]
    assert got["rain"].factors["rain_during_cure"] == "red"
    assert got["wet"].factors["rain_during_cure"] == "yellow"
    assert got["late rain"].issues == ["Rain likely in hours 24-48 (40%) — less critical but monitor"]
    assert got["gusts"].factors["wind_drying"] == "red" and "gust" in got["gusts"].issues[0].lower()
    assert got["breeze"].factors["wind_drying"] == "yellow"
    assert got["hot"].factors["heat_stress"] == "red"
    assert got["no rain data"].issues == ["Missing forecast data (precipitation) — treat with caution"]
    # the rolling form agrees at the first row of every site
    first = {r.station_id: r for r in cure.rolling_cure(df).filter(F.col("time") == F.lit("2024-05-06").cast("timestamp_ntz")).collect()}
    for s, r in got.items():
        assert (first[s].score, first[s].factors, first[s].issues) == (r.score, r.factors, r.issues)


def test_silent_sites_are_answered(spark):
    sites = spark.createDataFrame([("a", "x"), ("silent", "y"), ("silent", "z"), (None, "n")], "station_id string, name string")
    df = spark.createDataFrame(hour_rows("a", {h: {} for h in range(48)}), SCHEMA)
    found = {r["station_id"]: r for r in cure.cure_check(df, DAY0, sites).collect()}
    assert set(found) == {"a", "silent"} and found["a"]["score"] == "green"
    silent = found["silent"]
    assert (silent["score"], silent["verdict"], silent["hours"]) == (None, "NO DATA — DO NOT POUR", 0)
    assert silent["issues"] == ["No usable forecast data — cannot assess cure window"] and silent["temp_low_f"] is None
    sealed = {r["station_id"]: r for r in sealer.sealer_check(df, df, DAY0 + timedelta(hours=24), sites).collect()}
    assert set(sealed) == {"a", "silent"} and sealed["a"]["sealer_score"] is not None
    assert sealed["silent"]["sealer_score"] is None and sealed["silent"]["verdict"] == "NO DATA — DO NOT SEAL"
    none = cure.cure_check(df.limit(0), DAY0, sites).collect()
    assert {r["verdict"] for r in none} == {"NO DATA — DO NOT POUR"} and len(none) == 2
