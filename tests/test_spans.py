"""Span summaries against sums by hand."""

import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

from fieldcast.operators import jobs as J

DAILY = (
    "station_id string, observation_date date, temp_max_f decimal(5,1), temp_min_f decimal(5,1), precip_in decimal(5,2), "
    "wind_max_mph decimal(5,1), pour_score string, sealer_score string"
)
SPANS = "station_id string, start_date date, completion_date date"


def history(seed):
    rnd = random.Random(seed)
    rows = []
    for station, first, n in (("a", date(1999, 11, 20), 500), ("b", date(2000, 2, 28), 3), ("c", date(1950, 1, 1), 30_000)):
        for i in range(n):
            if rnd.random() < (0.02 if station == "c" else 0.6):
                maybe = lambda v: None if rnd.random() < 0.2 else v
                rows.append((
                    station, first + timedelta(days=i), maybe(Decimal(rnd.randrange(-300, 1000)) / 10), maybe(Decimal(rnd.randrange(-300, 900)) / 10),
                    maybe(Decimal(rnd.choice([0, 0, 5, 120])) / 100), maybe(Decimal(rnd.randrange(0, 500)) / 10),
                    rnd.choice(["green", "yellow", "red", None]), "red",
                ))
    return rows


def by_hand(rows, span):
    station, start, end = span
    if start is None or end is None:
        return None
    inside = [r for r in rows if r[0] == station and start <= r[1] <= end]
    if not inside:
        return None
    known = lambda k: [r[k] for r in inside if r[k] is not None]
    mean = lambda v: (sum(v) / len(v)).quantize(Decimal("0.1"), ROUND_HALF_UP) if v else None
    first = next((r for r in inside if r[1] == start), (None,) * 8)
    return (
        *span, mean(known(2)), mean(known(3)), sum(known(4), Decimal(0)), sum(v > 0 for v in known(4)), len(inside) - len(known(4)),
        *[sum(r[6] == s for r in inside) for s in ("green", "yellow", "red")], max(known(5), default=None), first[2], first[4], first[6],
    )


def test_span_sums_equal_sums_by_hand(spark):
    rows = history(1)
    rnd = random.Random(2)
    spans = {("a", date(1, 1, 1), date(9999, 12, 31)), ("c", date(1, 1, 1), date(9999, 12, 31)), ("b", date(2000, 2, 29), date(2000, 2, 29)), ("a", None, date(2000, 1, 1)), ("gone", date(2000, 1, 1), date(2000, 2, 1))}
    for _ in range(250):
        station, first, days = rnd.choice([("a", date(1999, 10, 1), 700), ("b", date(2000, 1, 1), 90), ("c", date(1949, 1, 1), 31_000)])
        start = first + timedelta(days=rnd.randrange(days))
        spans.add((station, start, start + timedelta(days=rnd.choice([-1, 0, 1, 5, 40, 300, 3000, 20_000]))))
    got = J.span_weather(spark.createDataFrame(sorted(spans, key=str), SPANS), spark.createDataFrame(rows, DAILY)).collect()
    want = [w for w in (by_hand(rows, s) for s in spans) if w]
    assert sorted(map(str, map(tuple, [[*map(plain, r)] for r in got]))) == sorted(map(str, map(tuple, [[*map(plain, r)] for r in want])))
    assert len(want) > 100


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


def test_spans_are_not_laid_out(spark):
    rows, long = history(1), [("a", date(1, 1, 1), date(9999, 12, 31))]
    daily = spark.createDataFrame(rows, DAILY)
    plan = J.span_weather(spark.createDataFrame(long, SPANS), daily)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    jobs = spark.createDataFrame([(1, *long[0]), (2, "a", date(2000, 1, 5), None)], f"job_id long, {SPANS}")
    days = J.job_days(jobs, daily).collect()
    assert len(days) == sum(r[0] == "a" for r in rows)


def test_repeated_spans_are_read_once(spark):
    rows = history(4)
    daily = spark.createDataFrame(rows, DAILY)
    spans = [("a", date(1999, 12, 3), date(1999, 12, 9)), ("a", date(1999, 11, 25), date(2000, 6, 2)), (None, date(2000, 1, 1), date(2000, 1, 2))]
    got = J.span_weather(spark.createDataFrame(spans * 3, SPANS), daily).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, s) for s in spans if by_hand(rows, s))
