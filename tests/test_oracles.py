"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql
from fieldcast.plans.catalogue import QUERIES
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
# nothing of the kind in the smallest tables
EMPTY_AT_SMALL_SCALE = {"wet_dry_streaks", "top_streaks", "top_anomalies", "best_work_weeks", "top_weeks", "one_job"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in oracle_sql() if n in QUERIES])
def test_query_equals_sql(spark, con, name):
    bad = differences(spark, con, QUERIES[name], oracle_sql()[name], FOLDER)
    if name in EMPTY_AT_SMALL_SCALE:
        bad = [b for b in bad if b != "no rows at all"]
    assert not bad, "\n".join(bad)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_but_the_fitted_model_has_sql():
    assert set(QUERIES) - set(oracle_sql()) == {"model_scores", "model_report"}
