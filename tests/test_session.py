"""The package where it is started from elsewhere, and the shared folder on a cluster."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from logloom import session

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import datetime as dt
from logloom.session import build_session, empty_table, local_table
from logloom.operators.catalog import add_patterns
from logloom.schemas import CATALOG
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
new = local_table(spark, [(1, "disk (?P<n>\\\\d+)", "s", "normal", None, None, None)],
                  "seq bigint, regex string, sample_message string, label string, severity string, component string, note string")
print("ADDED", add_patterns(empty_table(spark, CATALOG), new, dt.datetime(2025, 1, 1)).assigned.count())
"""


def test_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ADDED 1" in done.stdout, done.stderr[-1500:]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.staging_dir(Session())
