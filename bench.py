"""Headline queries: median of three full evaluations each. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldcast.plans import derive  # noqa: E402
from fieldcast.plans.catalogue import QUERIES  # noqa: E402
from fieldcast.session import build_session  # noqa: E402

HEADLINE = [
    "daily_scores", "parse_fixed_width", "temp_anomalies", "wet_dry_streaks", "monthly_viability", "coverage_audit",
    "year_over_year", "best_work_weeks", "station_pairs", "season_bounds", "job_weather", "job_days", "day_reasons",
    "best_window", "hourly_sealer", "cure_window", "sealer_check", "cure_check", "alert_dedup", "verdict_changes",
    "latest_snapshot", "keep_latest_n", "dq_report", "model_features",
]
# these write tables or run streams: once is enough
ONCE = ["stream_alerts", "stream_changes", "upsert_daily", "append_new"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "fieldcast-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    start = time.perf_counter()
    derive.fact_table(spark, folder)
    seconds["load_daily_facts"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    derive.archive_files(spark, folder)
    seconds["land_archive_files"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        seconds[name] = round(statistics.median(run(name) for _ in range(3)), 3)
    for name in ONCE:
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
