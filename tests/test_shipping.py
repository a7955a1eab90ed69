"""Operators with Python steps run when nothing but the driver knows where the package is."""

import os
import subprocess
import sys

from .conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from fieldcast.plans.catalogue import QUERIES
from fieldcast.session import build_session
spark = build_session("local[2]", "elsewhere", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})
for name in ("alert_dedup", "station_pairs"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_another_working_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
