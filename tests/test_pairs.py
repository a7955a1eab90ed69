"""Station pairs against exact fractions, and in order without a second comparison."""

import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import pairs
from fieldcast.plans import reports

DAILY = "station_id string, observation_date date, temp_max_f decimal(9,1), pour_score string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def drawn(stations: int, span: list[date], reach: int, grades, seed: int = 7):
    draw = random.Random(seed)
    return {
        (f"s{k:02d}", d): (draw.randint(-reach, reach), draw.choice(grades))
        for k in range(stations) for d in span if draw.random() < 0.5
    }


def frame(spark, facts):
    return spark.createDataFrame([(s, d, Decimal(t) / 10, v) for (s, d), (t, v) in facts.items()], DAILY)


def up(x: Fraction, digits: int) -> float:
    return float(Decimal(int(x * 10**digits * 2 + 1) // 2).scaleb(-digits))


def wanted(facts, stations: int) -> dict:
    out = {}
    for a in range(stations):
        for b in range(a + 1, stations):
            x, y = f"s{a:02d}", f"s{b:02d}"
            both = [(facts[x, d], facts[y, d]) for s, d in facts if s == x and (y, d) in facts]
            if not both:
                continue
            n, gaps = len(both), [abs(p[0] - q[0]) for p, q in both]
            other = sum(1 for p, q in both if p[1] and q[1] and p[1] != q[1])
            s = lambda f: sum(f(p[0], q[0]) for p, q in both)
            spread = sqrt(n * s(lambda p, q: p * p) - s(lambda p, q: p) ** 2) * sqrt(n * s(lambda p, q: q * q) - s(lambda p, q: q) ** 2)
            corr = (n * s(lambda p, q: p * q) - s(lambda p, q: p) * s(lambda p, q: q)) / spread if spread else None
            corr = None if corr is None else float(Decimal(repr(corr)).quantize(Decimal("0.001"), ROUND_HALF_UP)) + 0.0
            out[x, y] = (n, up(Fraction(sum(gaps), 10 * n), 1), max(gaps) / 10, other, up(Fraction(100 * other, n), 1), corr)
    return out


def found(df) -> dict:
    return {
        (r.station_a, r.station_b): (r.compared_days, float(r.avg_temp_diff_f), float(r.max_temp_diff_f), r.score_disagree_days, float(r.pct_disagree), r.temp_correlation)
        for r in df.collect()
    }


@pytest.mark.parametrize(
    "reach, grades",
    [(400, ["green", "yellow", "red"]), (30_000, ["green", "red", None]), (9_000_000, ["yellow", None])],
)
def test_pairs_equal_exact_fractions(spark, reach, grades):
    """Five tiles of years; gaps of 16 and of 32 bits; sums that share a product and sums that don't; days without a verdict."""
    span = [date(y, m, 1) for y in (1996, 2001, 2004, 2009, 2015) for m in (1, 2, 12)]
    facts = drawn(9, span, reach, grades)
    stations = spark.createDataFrame([(f"s{k:02d}", f"n{k}") for k in range(9)], "station_id string, name string")
    assert found(pairs.station_pairs(frame(spark, facts), stations, 4)) == wanted(facts, 9)


def test_pairs_leave_their_cell_as_they_are_returned(spark):
    stations = spark.createDataFrame([("s00", "a"), ("s01", "b")], "station_id string, name string")
    facts = drawn(2, [date(2001, 1, 1) + timedelta(k) for k in range(9)], 50, ["green"])
    above = plan_of(pairs.station_pairs(frame(spark, facts), stations)).split("_cell(")[0]
    assert "Project" not in above and "decimal" not in above


def test_thousandths_are_rounded_as_spark_rounds(spark):
    x = np.array([0.0625, -0.0625, 0.0005, 0.1235, -0.9995, 1.0000000000000002, 0.0004999999999, 0.0, -0.0001, 0.4445, 0.28349999999999997])
    want = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 3)).collect()
    assert (pairs._rounded(x) / 1000).tolist() == [r[0] for r in want]


def test_the_report_is_in_order_and_compares_once(spark, monkeypatch):
    """Many pairs with the same share of days, more than a part should have; a station with two names, one without any."""
    monkeypatch.setattr(pairs, "ORDERED_PAIRS", 60)
    monkeypatch.setattr(pairs, "RUN_PAIRS", 1)
    monkeypatch.setattr(pairs, "BLOCK_STATIONS", 4)
    facts = drawn(30, [date(2001, 1, 1) + timedelta(k) for k in range(6)], 90, ["green", "yellow"])
    names = [(f"s{k:02d}", f"n{k}", "x" if k % 3 else None) for k in range(30)] + [("s01", "other", "x"), ("s07", None, "x")]
    stations = spark.createDataFrame(names, "station_id string, name string, state string")
    daily = frame(spark, facts)
    report = reports.comparison(daily, stations, "state")
    assert report.rdd.getNumPartitions() > 2 and "Sort" not in plan_of(report).split("_runs(")[0]
    got = report.collect()
    order = [(-r.pct_disagree, r.station_a, r.station_b) for r in got]
    assert order == sorted(order) and len({k[0] for k in order}) > 3
    plain = pairs.station_pairs(daily, stations, within="state")
    assert sorted(map(str, got)) == sorted(map(str, plain.collect())) and report.schema == plain.schema
    assert reports.comparison(daily.limit(0), stations, "state").count() == 0
    assert reports.comparison(daily, stations.limit(0), "state").count() == 0
