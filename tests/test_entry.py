"""The registered queries: complete, named alike in both engines, equal on the smallest tables."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    own = {n for n in names if not re.match(r"op\d+_|pipeline$", n)}  # the optional queries are tested with their operators
    assert own <= set(entry.oracle_sql())


def test_flagship_query(spark):
    rows = {r["action"]: r["requests"] for r in entry.entry(spark).collect()}
    assert sum(rows.values()) == 1000 and rows["allow"] > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables not present")
def test_queries_equal_sql():
    names = ["decayed_risk", "feat_payload", "feedback_decision", "asof_blocks", "payload_clusters", "campaigns"]
    out = subprocess.run([sys.executable, f"{ROOT}/tools/check.py", FOLDER, *names], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stdout[-2000:] + out.stderr[-500:]
