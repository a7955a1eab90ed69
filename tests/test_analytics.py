"""Edge rules of the analytics, checks and model."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import climate, daily as day_ops, jobs, model, pairs, quality
from fieldcast.plans import derive as D, reports

SF = "/root/testdata/sf0.001"
DAILY = ("station_id string, observation_date date, temp_max_f decimal(5,1), temp_min_f decimal(5,1), temp_mean_f decimal(5,1), "
         "precip_in decimal(5,2), wind_max_mph decimal(5,1), pour_score string, sealer_score string")


def dec(v):
    return None if v is None else Decimal(str(v))


def days(spark, rows):
    """rows: (station, day number, high, low, mean, rain, wind, pour, sealer)"""
    start = date(2023, 3, 1)
    return spark.createDataFrame(
        [(s, start + timedelta(days=n), dec(a), dec(b), dec(c), dec(p), dec(w), x, y) for s, n, a, b, c, p, w, x, y in rows], DAILY)


def named(spark, *ids):
    return spark.createDataFrame([(i, f"town {i}", "area") for i in ids], "station_id string, name string, covers string")


def plain(s, n, rain=0, pour="green", mean=60):
    return (s, n, 70, 50, mean, rain, 5, pour, pour)


def test_streaks_break_on_missing_dates_and_unknown_rain_is_dry(spark):
    rows = [plain("a", n, rain=None if n == 1 else 0) for n in (0, 1, 2, 4, 5, 6, 7)] + [plain("a", 3, rain=0.2)]
    rows += [plain("b", n) for n in (0, 1, 3, 4)]
    got = climate.weather_streaks(days(spark, rows), named(spark, "a", "b")).orderBy("streak_start").collect()
    assert [(r.station_id, r.streak_type, r.streak_days, r.streak_rank) for r in got] == [("a", "DRY", 3, 2), ("a", "DRY", 4, 1)]


def test_a_station_without_rows_counts_one_missing_reading(spark):
    got = {r.station_id: r for r in climate.coverage_audit(days(spark, [plain("a", 0), plain("a", 3)]), named(spark, "a", "z")).collect()}
    assert (got["a"].expected_days, got["a"].days_with_data, got["a"].gap_days, got["a"].coverage_pct) == (4, 2, 2, Decimal("50.0"))
    assert (got["z"].days_with_data, got["z"].missing_temp, got["z"].missing_precip, got["z"].gap_days) == (0, 1, 1, 4)
    assert climate.date_spine(days(spark, [plain("a", 0), plain("a", 3)])).count() == 4


def test_anomaly_flags_at_the_limits(spark):
    flat = [plain("a", n, mean=60) for n in range(20)] + [plain("a", 20, mean=75)]
    got = climate.temperature_anomalies(days(spark, flat), named(spark, "a")).orderBy("observation_date").collect()
    assert {r.anomaly_flag for r in got[:20]} == {"NORMAL"}  # no deviation and no difference
    assert got[0].temp_30d_stddev is None and got[20].anomaly_flag == "EXTREME"
    assert float(got[20].temp_7d_avg) == 62.1 and float(got[20].temp_anomaly) == 12.9


def test_correlation_of_a_constant_station_is_null(spark):
    rows = [plain("a", n) for n in range(5)] + [("b", n, 60 + n, 50, 60, 0, 5, None if n == 0 else "red", None) for n in range(5)]
    got = pairs.station_pairs(days(spark, rows), named(spark, "a", "b"), 2).collect()
    assert len(got) == 1 and got[0].temp_correlation is None
    assert (got[0].compared_days, got[0].score_disagree_days, float(got[0].max_temp_diff_f)) == (5, 4, 10.0)


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_pairs_do_not_depend_on_the_blocks(spark, blocks):
    facts, stations = D.regional_daily(spark, SF), D.regional_stations(spark, SF)
    a, b = pairs.station_pairs(facts, stations, blocks), pairs.station_pairs(facts.repartition(9), stations, 5)
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_pairs_within_a_column_and_blocks_from_the_count(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_STATIONS", 3)
    facts, stations = D.daily(spark, SF), D.stations(spark, SF)
    stations = stations.withColumn("state", F.when(F.col("state") != "ASIA", F.col("state")))
    team = {r.station_id: r.state for r in stations.collect()}
    whole = [r for r in pairs.station_pairs(facts, stations, 1).collect()]
    assert sorted(map(str, pairs.station_pairs(facts, stations).collect())) == sorted(map(str, whole))
    got = pairs.station_pairs(facts, stations, within="state").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in whole if team[r.station_a] == team[r.station_b])
    assert 0 < len(got) <= len(whole)
    assert pairs.station_pairs(facts.limit(0), stations.limit(0)).count() == 0


def test_pairs_against_loops_over_years_and_cells(spark):
    """Nine blocks of forty stations with gaps, missing verdicts, leap days and two tiles of years."""
    import random

    draw = random.Random(4)
    span = [date(2003, 12, 30) + timedelta(n) for n in range(4)] + [date(2004, 2, 29), date(2004, 12, 31), date(2007, 12, 31), date(2008, 1, 1)]
    facts = {
        (f"s{k:02d}", d): (draw.randint(-400, 1200), draw.choice(["green", "yellow", "red", None]))
        for k in range(40) for d in span if draw.random() < 0.6
    }
    rows = [(s, d, dec(t / 10), v) for (s, d), (t, v) in facts.items()]
    daily = spark.createDataFrame(rows, "station_id string, observation_date date, temp_max_f decimal(5,1), pour_score string")
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both = [(facts[f"s{a:02d}", d], facts[f"s{b:02d}", d]) for d in span if (f"s{a:02d}", d) in facts and (f"s{b:02d}", d) in facts]
            if both:
                gaps = [abs(x[0] - y[0]) for x, y in both]
                want[f"s{a:02d}", f"s{b:02d}"] = (len(both), max(gaps), sum(1 for x, y in both if x[1] and y[1] and x[1] != y[1]))
    frame = pairs.station_pairs(daily, named(spark, *[f"s{k:02d}" for k in range(40)]), 9)
    got = {(r.station_a, r.station_b): (r.compared_days, round(float(r.max_temp_diff_f) * 10), r.score_disagree_days) for r in frame.collect()}
    assert got == want
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    # copies are made of tiles, above the step that packs them, and of nothing else
    assert plan.count("explode(") == 1 and plan.index("explode(") < plan.index("_tile(")


def test_previous_year_is_the_previous_present_one(spark):
    rows = spark.createDataFrame(
        [("a", date(y, 5, 1), dec(t), "green", dec(0)) for y, t in ((2001, 50), (2004, 55), (2005, 53))],
        "station_id string, observation_date date, temp_mean_f decimal(5,1), pour_score string, precip_in decimal(5,2)")
    got = climate.year_over_year(rows, named(spark, "a")).orderBy("year").collect()
    assert [r.temp_change_yoy and float(r.temp_change_yoy) for r in got] == [None, 5.0, -2.0]
    assert got[0].month_name == "May"


def test_season_ignores_days_outside_the_band(spark):
    rows = spark.createDataFrame(
        [("a", date(2023, m, d), s) for m, d, s in ((1, 5, "green"), (3, 1, "yellow"), (3, 9, "red"), (12, 6, "green"), (12, 7, "green"))],
        "station_id string, observation_date date, pour_score string")
    r = climate.season_bounds(rows, named(spark, "a")).first()
    assert (r.season_start_approx, r.season_end_approx, r.total_green_days, r.total_yellow_days) == (date(2023, 3, 1), date(2023, 12, 6), 1, 1)


def test_jobs(spark):
    start = date(2023, 3, 1)
    rows = [(1, start, start + timedelta(days=1), dec("100.00"), 0), (2, start, start + timedelta(days=1), dec("10.00"), 3),
            (3, start, None, dec("1.00"), 1), (4, None, start, dec("1.00"), 1), (5, start, start - timedelta(days=1), dec("1.00"), 1)]
    table = spark.createDataFrame(rows, "job_id int, start_date date, completion_date date, final_revenue decimal(10,2), square_footage int")
    for c in ("lead_name", "address", "job_type", "concrete_type"):
        table = table.withColumn(c, F.lit("x"))
    staged = day_ops.stage_jobs(table.withColumn("sealer_coats", F.lit(1)).withColumn("station_id", F.lit("a")))
    weather = days(spark, [plain("a", 0, rain=None), plain("a", 1, rain=0.3, pour="red")]).withColumn("snow_in", F.lit(None))
    got = {r.job_id: r for r in jobs.job_weather(staged, weather, named(spark, "a")).collect()}
    assert set(got) == {1, 2}
    assert got[1].revenue_per_sqft is None and float(got[2].revenue_per_sqft) == 3.33
    assert (got[1].rainy_days, got[1].missing_precip_days, got[1].green_days, got[1].red_days) == (1, 1, 1, 1)
    assert got[1].pour_day_score == "green" and got[1].pour_day_precip is None and float(got[1].total_precip_in) == 0.3
    assert jobs.job_days(staged, weather).count() == 4
    assert [r.job_id for r in reports.job_list(staged, weather, named(spark, "a")).collect()] == [1, 2]
    assert reports.one_job(staged, weather, 2).count() == 2
    assert quality.jobs_without_weather(staged, days(spark, [plain("a", 1)])).count() == 4


def test_reports(spark):
    facts, stations = D.fact_table(spark, SF), D.stations(spark, SF)
    town = reports.town_station(stations, stations.first().name)
    assert town is not None and reports.town_station(stations, "nowhere") is None
    mine = reports.seasonal(facts, stations, town).collect()
    assert {r.station_id for r in mine} == {town}
    assert len(reports.seasonal(facts, stations, None).collect()) > len(mine)
    plan = reports.anomalies(facts, stations, town)._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(station_id,{town})" in plan  # the town reaches the scan, below the windows
    coverage = [r.coverage_pct for r in reports.quality(facts, stations).collect()]
    assert coverage == sorted(coverage)
    assert all(r.prev_year_avg_temp is not None for r in reports.yearly_change(facts, stations).collect())
    assert reports.seasons(facts, stations, town).count() > 0
    shares = [r.pct_disagree for r in reports.comparison(D.regional_daily(spark, SF), D.regional_stations(spark, SF)).collect()]
    assert shares == sorted(shares, reverse=True)
    assert reports.streaks(facts, stations, streak_type="neither").count() >= 0
    assert reports.best_weeks(facts, stations, year=1999).filter("year(week_ending) <> 1999").count() == 0


def test_checks_find_what_is_wrong(spark):
    bad = days(spark, [plain("a", 0), plain("a", 0), (None, 1, 130, -50, 1, 0, 1, "blue", None), plain("q", 2)])
    rules = [r for r in quality.standard_rules(date(2023, 3, 1)) if r.table in ("daily", "stations")]
    got = {(r.check, r.column): r.failures for r in quality.run_checks({"daily": bad, "stations": named(spark, "a")}, rules).filter("table = 'daily'").collect()}
    assert got == {
        ("unique", "station_id,observation_date"): 1, ("not_null", "station_id"): 1, ("not_null", "observation_date"): 0,
        ("references", "station_id"): 1, ("accepted", "pour_score"): 1, ("accepted", "sealer_score"): 0,
        ("range", "temp_max_f"): 1, ("range", "temp_min_f"): 1, ("not_after", "observation_date"): 1,
    }
    assert quality.unrealistic_temperatures(bad).count() == 1 and quality.future_observations(bad, date(2023, 3, 1)).count() == 1


def test_key_rules_count_rows_and_keys_in_one_aggregate_over_two_scans(spark, tmp_path):
    """Repeats, NULL parts, keys of another type, a target without rows and a frequent stray key."""
    parent = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (None, "x"), (2, "x")], "id bigint, part string")
    child = spark.createDataFrame([(n, i, p) for n, (i, p) in enumerate([(1, "x")] + [(9, "x")] * 50 + [(None, "x"), (2, None), (2, "y")])],
                                  "no int, id int, part string")
    parent.write.parquet(f"{tmp_path}/parent")
    child.write.parquet(f"{tmp_path}/child")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("parent", "child")} | {"none": parent.limit(0)}
    R = quality.Rule
    rules = [
        R("unique", "parent", "id"), R("unique", "parent", "id,part"), R("unique", "child", "no"), R("unique", "none", "id"),
        R("references", "child", "id", ("parent", "id")), R("references", "child", "id,part", ("parent", "id,part")),
        R("references", "child", "id", ("none", "id")), R("not_null", "child", "part"), R("references", "child", "id", ("absent", "id")),
    ]
    frame = quality.run_checks(tables, rules)
    got = [(r.check, r.table, r.column, r.failures) for r in frame.collect()]
    assert sorted(got) == sorted([
        ("unique", "parent", "id", 2), ("unique", "parent", "id,part", 1), ("unique", "child", "no", 0), ("unique", "none", "id", 0),
        ("references", "child", "id", 50), ("references", "child", "id,part", 51), ("references", "child", "id", 53),
        ("not_null", "child", "part", 1),
    ])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and "Join" not in plan  # child twice, parent once


def test_model(spark):
    rows = model.split_in_order(model.features(model.training_rows(D.fact_table(spark, "/root/testdata/sf0.01"))))
    total, first = rows.count(), rows.filter("is_train").count()
    assert first == int(total * 0.8)
    last_train = rows.filter("is_train").agg(F.max("observation_date")).first()[0]
    assert rows.filter("not is_train").agg(F.min("observation_date")).first()[0] >= last_train
    fitted = model.train(rows.filter("is_train"))
    scores = {r.is_train: r.accuracy for r in model.accuracy(fitted.score(rows)).collect()}
    assert scores[True] > 0.85 and scores[False] > 0.85
    assert fitted.importance()[0][0] in model.FEATURES and len(fitted.importance()) == 5
    examples = spark.createDataFrame(
        [(70.0, 55.0, 15.0, 0.0, 5.0), (75.0, 60.0, 15.0, 0.5, 20.0)], ", ".join(f"{f} double" for f in model.FEATURES))
    fine, wet = (r.probability_green for r in fitted.score(examples).collect())
    assert fine > 0.5 > wet


def test_model_equals_a_newton_fit(spark):
    """Weights, accuracy and order of importance against numpy, with the moments of the training rows alone."""
    import numpy as np

    rows = model.split_in_order(model.features(model.training_rows(D.fact_table(spark, "/root/testdata/sf0.01")))).persist()
    pdf = rows.toPandas()
    x, y, train = pdf[model.FEATURES].to_numpy(), pdf["label"].to_numpy(), pdf["is_train"].to_numpy()
    mean, deviation = x[train].mean(axis=0), x[train].std(axis=0)
    z = np.hstack([(x - mean) / (deviation + model.EPSILON), np.ones((len(x), 1))])
    w, penalty = np.zeros(6), np.diag([1e-3] * 5 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z[train] @ w))
        slope = z[train].T @ (p - y[train]) / train.sum() + penalty @ w
        w -= np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train] / train.sum() + penalty + 1e-12 * np.eye(6), slope)
    fitted = model.train(rows.filter("is_train"))
    stats = model.moments(rows.filter("is_train"))
    assert np.allclose([stats[f] for f in model.FEATURES], np.stack([mean, deviation], 1), rtol=1e-9)
    # range is high less low: the three weights are held apart by the penalty alone, so the fit is compared by its scores
    scored = fitted.score(rows).toPandas().set_index(["station_id", "observation_date"])["probability_green"]
    want = 1 / (1 + np.exp(-z @ w))
    got = scored.loc[list(zip(pdf["station_id"], pdf["observation_date"]))].to_numpy()
    assert np.abs(got - want).max() < 0.02
    said = {(r.section, r.name): (r.n, r.value) for r in model.report(fitted, fitted.score(rows)).collect()}
    for name, part in (("train", train), ("test", ~train)):
        right = ((want[part] >= 0.5) == (y[part] == 1)).mean()
        assert said["accuracy", name][0] == part.sum() and abs(said["accuracy", name][1] - right) < 0.003
        assert said["accuracy", name][1] >= 0.9
    assert said["label", "green"] == (int(y.sum()), pytest.approx(y.mean()))
    assert said["label", "not green"][0] == len(y) - int(y.sum())
    order = sorted((n, name) for (section, name), (n, _) in said.items() if section == "importance")
    assert [n for n, _ in order] == [1, 2, 3, 4, 5] and order[0][1] == model.FEATURES[int(np.abs(w[:5]).argmax())]
    rows.unpersist()


def test_lookups_by_text(spark):
    daily = days(spark, [plain("a", 0), plain("a", 1), plain("z", 1)]).withColumn("obs_year", F.year("observation_date"))
    stations = named(spark, "a", "b").unionByName(named(spark, "z").withColumn("name", F.lit("town a")))
    asked = spark.createDataFrame(
        [(1, "town a", "2023-03-01"), (2, "town a", "2023-03-03"), (3, "town a", "2023-02-30"), (4, "town a", "2023-3-1"), (5, "town a", None),
         (6, "town x", "2023-02-30"), (7, None, "2023-03-01"), (8, "town b", "2023-03-01"), (1, "town a", "2023-03-01")], "k int, town string, date string")
    got = [(r.k, r.status, r.station_id, r.pour_score) for r in reports.points_by_text(asked, stations, daily).orderBy("k").collect()]
    assert got == [
        (1, "ok", "a", "green"), (1, "ok", "a", "green"), (2, "no data", "a", None), (3, "invalid date", "a", None), (4, "invalid date", "a", None),
        (5, "invalid date", "a", None), (6, "unknown town", None, None), (7, "unknown town", None, None), (8, "no data", "b", None),
    ]
